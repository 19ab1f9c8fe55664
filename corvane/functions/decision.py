"""Decision rules over intervals and codes as column expressions (FLT09, NUM03-NUM06, AGG35-AGG37)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVAL = "struct<point:double,lower:double,upper:double,n:int>"
#: Codes of a response, and those that insulate.
INSULATING = ("C", "D", "B_TO_C")
DETERMINATE = ("healthy", "insulated")
NOT_SCORED = ("closed", "out_of_scope")


def _yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def inside(iv: Column, band: Column) -> Column:
    return _yes((iv["lower"] >= -band) & (iv["upper"] <= band))


def beyond_positive(iv: Column, band: Column) -> Column:
    return _yes(iv["lower"] > band)


def beyond_negative(iv: Column, band: Column) -> Column:
    return _yes(iv["upper"] < -band)


def wholly_below(iv: Column, threshold: Column) -> Column:
    return _yes(iv["upper"] < threshold)


def at_or_above(iv: Column, threshold: Column) -> Column:
    return _yes(iv["lower"] >= threshold)


def direction(iv: Column, threshold: Column) -> Column:
    """A below the threshold, S above, else null."""
    return F.when(wholly_below(iv, threshold), F.lit("A")).when(_yes(iv["lower"] > threshold), F.lit("S"))


def opposite(side: Column) -> Column:
    return F.when(side == "p", F.lit("not_p")).when(side == "not_p", F.lit("p")).otherwise(side)


def final_code(code: Column, outcome: Column, names_auxiliary: Column, opened: Column, last_interim: Column, as_of: Column, idle_years: float, unnamed: str | None) -> Column:
    """The code of a ledger entry once its round is closed; null where the rule on unnamed rounds excludes it.

    ``unnamed``: as_named, exclude, or None where no rule is fixed, which raises on such a round.
    """
    closed = (
        F.when(outcome.isin("success", "fail_debit"), F.lit("B_RESOLVED"))
        .when(outcome == "fail_no_debit", F.lit("B_TO_C"))
        .otherwise(F.when(as_of - F.coalesce(last_interim, opened) >= idle_years, F.lit("B_TO_C")).otherwise(F.lit("B_OPEN")))
    )
    if unnamed == "exclude":
        closed = F.when(names_auxiliary.isNotNull(), closed)
    elif unnamed is None:
        closed = F.when(names_auxiliary.isNotNull(), closed).otherwise(F.raise_error(F.lit("a round names no tested auxiliary, and no rule is set")).cast("string"))
    return F.when(code.isin("A", "C", "D"), code).otherwise(closed)


def reading(delta: Column, omega: Column, insulating: Column, loop: Column, band: Column, most: Column, least_loop: Column) -> Column:
    """struct<reading, note> of the primary reading of one orientation."""
    asymmetric = beyond_positive(delta, band) | beyond_positive(omega, band)
    looped = at_or_above(loop, least_loop)
    missing = F.concat_ws(", ", *[F.when(iv.isNull(), F.lit(name)) for name, iv in (("Δ", delta), ("Ω", omega), ("insulating share", insulating), ("L", loop))])

    def said(kind: str, note: Column) -> Column:
        return F.struct(F.lit(kind).alias("reading"), note.alias("note"))

    none = F.lit(None).cast("string")
    return (
        F.when(inside(delta, band) & inside(omega, band) & wholly_below(insulating, most), said("S", none))
        .when(asymmetric & looped, said("A", none))
        .when(beyond_negative(delta, band) | beyond_negative(omega, band), said("unclear", F.lit("asymmetry points away from the favoured side (harsher on its own side); not insulation")))
        .when(missing != "", said("unclear", F.concat(F.lit("not computable: "), missing)))
        .when(asymmetric, said("unclear", F.lit("asymmetry beyond δ without a loop of at least k")))
        .when(looped, said("unclear", F.lit("loop of at least k without asymmetry beyond δ")))
        .otherwise(said("unclear", F.lit("an interval straddles its threshold")))
    )


def primary_reading(oriented: Column) -> Column:
    """struct<reading, side, note> over an array of (side, reading, note): one, or both sides of a tie."""
    first = F.get(oriented, F.lit(0))
    toward = F.filter(oriented, lambda o: o["reading"] == "A")
    none = F.lit(None).cast("string")

    def said(kind: Column, side: Column, note: Column) -> Column:
        return F.struct(kind.alias("reading"), side.alias("side"), note.alias("note"))

    notes = F.array_join(F.transform(F.filter(oriented, lambda o: o["note"].isNotNull()), lambda o: F.concat(o["side"], F.lit(": "), o["note"])), "; ")
    return (
        F.when(F.size(oriented) == 1, said(first["reading"], first["side"], first["note"]))
        .when(F.forall(oriented, lambda o: o["reading"] == "S"), said(F.lit("S"), F.lit("both"), none))
        .when(F.size(toward) == 1, said(F.lit("A"), F.get(toward, F.lit(0))["side"], none))
        .when(F.size(toward) > 1, said(F.lit("unclear"), none, F.lit("asymmetric toward both sides")))
        .otherwise(said(F.lit("unclear"), none, notes))
    )


def verdict(m: dict[str, Column], p: dict[str, Column]) -> Column:
    """struct<verdict, reason, note, corroboration, side>.

    ``m``: closed, cites, disconfirmations, members, citations, coverage, favoured, primary
    (of ``primary_reading``), tau, tau_measurable, honoured, honoured_measurable; ``p``: n, m, v, r, t, h.
    """
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<string>")

    def said(kind: Column, reason: str | None, note: Column, corroboration: Column, side: Column) -> Column:
        return F.struct(kind.alias("verdict"), F.lit(reason).cast("string").alias("reason"), note.alias("note"), corroboration.alias("corroboration"), side.alias("side"))

    short = F.concat_ws(
        "; ",
        F.when(m["disconfirmations"] < p["n"], F.concat(F.lit("disconfirmations "), m["disconfirmations"].cast("string"), F.lit(" < n="), p["n"].cast("string"))),
        F.when(m["members"] < p["m"], F.concat(F.lit("members "), m["members"].cast("string"), F.lit(" < m="), p["m"].cast("string"))),
        F.when(m["citations"] < p["v"], F.concat(F.lit("citations "), m["citations"].cast("string"), F.lit(" < v="), p["v"].cast("string"))),
        F.when(m["coverage"] < p["r"], F.concat(F.lit("coverage "), F.format_string("%.2f", m["coverage"]), F.lit(" < r="), p["r"].cast("string"))),
    )
    read = m["primary"]
    tau = F.when(m["tau_measurable"], direction(m["tau"], p["t"]))
    honoured = F.when(m["honoured_measurable"], direction(m["honoured"], p["h"]))

    def conflict(name: str, way: Column) -> Column:
        return F.concat(F.lit(f"{name} points to "), way, F.lit(" against reading "), read["reading"])

    agreed = F.filter(F.array(F.when(tau.isNotNull(), F.lit("τ")), F.when(honoured.isNotNull(), F.lit("H"))), lambda x: x.isNotNull())
    return (
        F.when(m["closed"], said(F.lit("closed"), None, none, nothing, none))
        .when(~m["cites"], said(F.lit("out_of_scope"), None, none, nothing, none))
        .when(short != "", said(F.lit("indeterminate"), "insufficient_data", short, nothing, m["favoured"]))
        .when(read["reading"] == "unclear", said(F.lit("indeterminate"), "reading_unclear", read["note"], nothing, m["favoured"]))
        .when(_yes(tau != read["reading"]), said(F.lit("indeterminate"), "conduct_conflict", conflict("τ", tau), nothing, m["favoured"]))
        .when(_yes(honoured != read["reading"]), said(F.lit("indeterminate"), "conduct_conflict", conflict("H", honoured), nothing, m["favoured"]))
        .otherwise(said(F.when(read["reading"] == "S", F.lit("healthy")).otherwise(F.lit("insulated")), None, none, agreed, read["side"]))
    )
