"""Identifiers, references and decisions on hand-computed values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.functions import biblio, citations, decision, ids, redaction, references, text
from corvane.plans import textual


def values(spark, rows, ddl, column):
    return [r[0] for r in spark.createDataFrame(rows, ddl).coalesce(1).select(column).collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def refs(spark, rows):
    """References from dicts of fields."""
    ddl = biblio.REFERENCE.removeprefix("struct<").removesuffix(">")
    names = [f.name for f in StructType.fromDDL(ddl.replace(":", " ").replace(",", ", "))]
    df = spark.createDataFrame([(i, tuple(r.get(n) for n in names)) for i, r in enumerate(rows)], f"i int, ref {biblio.REFERENCE}")
    return df.orderBy("i")


def test_identifiers(spark):
    got = values(spark, [("https://openalex.org/W12",), ("W12/",), ("",), (None,)], "x string", ids.short_id(F.col("x")))
    assert got == ["W12", "W12", None, None]
    got = values(spark, [("https://DOI.org/10.1/A ",), (" doi:10.2/b",), ("http://dx.doi.org/",), ("10.3/C",), (None,)], "x string", ids.normalize_doi(F.col("x")))
    assert got == ["10.1/a", "10.2/b", None, "10.3/c", None]
    names = [("Tamsin R. Penrow",), ("T. R. Penrow",), ("Vera L. Quill",), ("Müller, Ánna",), ("...",), (None,), ("Ardo",)]
    assert values(spark, names, "x string", ids.name_key(F.col("x"))) == ["penrow:tr", "penrow:tr", "quill:vl", "anna:m", None, None, "ardo:"]
    assert values(spark, [("Ángström-ß",)], "x string", ids.fold_unicode(F.col("x"))) == ["angstrom"]
    keys = spark.createDataFrame([("A1", "Tamsin R. Penrow"), ("name:ardo:m", None)], "a string, n string").select(ids.node_key(F.col("a"), F.col("n"), True)).collect()
    assert [r[0] for r in keys] == ["penrow:t", "ardo:m"]
    assert one(spark, ids.frame_lineage(ids.frame_id(F.lit("L@1"), F.lit(1990)))) == "L@1"
    assert one(spark, ids.frame_start(ids.frame_id(F.lit("L@1"), F.lit(1990)))) == 1990
    a, b = (F.create_map(F.lit(x), F.lit("1"), F.lit(y), F.lit("2")) for x, y in (("p", "q"), ("p", "q")))
    assert one(spark, ids.request_key(F.lit("s"), F.lit("u"), a) == ids.request_key(F.lit("s"), F.lit("u"), b))
    assert one(spark, ids.run_id(F.lit("2026-09-14 17:34:00").cast("timestamp"), F.lit("SIM thresholds"), F.lit("x!"))) == "2026-09-14T1734Z-sim-thresholds-x"
    assert one(spark, ids.percent(F.lit(0.1234))) == "12.3%" and one(spark, ids.interval_text(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0))) == "—"


def test_dates_order(spark):
    got = values(spark, [("1990",), ("1990-12-01",), ("1990-03",), ("1990-03-31",)], "x string", ids.decimal_year(F.col("x")))
    assert got[0] > got[1] > got[2] == got[3]


def test_citation_layouts(spark):
    cases = [
        (dict(year=1983, volume="D27", first_page="1672", journal="Phys. Rev."), (1983, "27", "1672", "Phys. Rev.")),
        (dict(year=1983, volume="125B", first_page="355"), (1983, "125", "355", None)),
        (dict(year=1941, volume="12", first_page="51 ff"), (1941, "12", "51", None)),
        (dict(year=1984, volume="Vol. I", first_page="259"), None),
        (dict(year=1990, volume="12, 3", first_page="4"), None),
        (dict(text="K. Ostrel et al., Mar. Sed. Lett. 56, 3 (1986)."), (1986, "56", "3", None)),
        (dict(text="R. Tolmar, J. Exptl. Hydrol. 261:301-308 (1989a)"), (1989, "261", "301", None)),
        (dict(text="A.B. Corrin, D.E. Fell and G.H. Ives: Geol. Rev. D33 3487 (1986)"), (1986, "33", "3487", None)),
        (dict(text="[3] Oskar P. Lund et al., Survey, Harbour Technol. 25 (1994) 478."), (1994, "25", "478", None)),
        (dict(text="Tolmar, R., Induced runoff. J. Exptl. Hydrol., 1989. 261: p. 301."), (1989, "261", "301", None)),
        (dict(text="Marchal E, et al. Mussel shell abrasion. Tides. 1988;333(6176):816-8."), (1988, "333", "816", None)),
        (dict(text="[11] Arden, Boswell, Harbour Mechanics (Pergamon, Oxford, 1965)."), None),
    ]
    got = refs(spark, [c for c, _ in cases]).select(biblio.biblio_of(F.col("ref")).alias("b")).collect()
    assert [None if r.b is None else tuple(r.b) for r in got] == [w for _, w in cases]


def test_reference_kinds(spark):
    cases = [
        (dict(year=1983, volume="D27", first_page="1672", journal="Phys. Rev."), "paper"),
        (dict(year=1983, first_page="244", series_title="AIP Conf. Proc. No. 99"), "paper"),
        (dict(text="Brandt U.V., Commun. Tidal Phys. 25, 167 (1972)"), "paper"),
        (dict(doi="10.1/any"), "paper"),
        (dict(year=1982, volume_title="Shoreline Wave Tables and Estuary Decay"), "excluded"),
        (dict(year=1984, journal="SLAC-PUB-3304"), "excluded"),
        (dict(year=1989, first_page="69", journal="US Department of Energy, DOE/S-0073"), "excluded"),
        (dict(text="Penrow AB. Keepers' attitudes to lighthouse work [MD Thesis]. London, 1986."), "excluded"),
        (dict(text="Q.R. Vellani, to be published."), "excluded"),
        (dict(text="[11] Arden, Boswell, Harbour Mechanics (Pergamon, Oxford, 1965)."), "excluded"),
        (dict(text="New Scientist 9 March 1991 p. 12."), "excluded"),
        (dict(year=1978), "unclassifiable"),
        (dict(text="Anon (" + "A" * 200 + " 1999 no closing bracket"), "unclassifiable"),
    ]
    got = refs(spark, [c for c, _ in cases]).select(biblio.reference_kind(F.col("ref")).alias("k")).collect()
    assert [r.k for r in got] == [w for _, w in cases]


@pytest.mark.parametrize(
    ("cited", "name", "want"),
    [
        ("Phys. Rev. Lett.", "Physical Review Letters", True),
        ("Nucl. Instrum. Methods Phys. Res. A", "Nuclear Instruments and Methods in Physics Research Section A: Accelerators, Spectrometers", True),
        ("Nature", "Nature Physics", False),
        ("Phys. Rev. Lett.", "Physics Letters B", False),
        ("", "Nature", False),
    ],
)
def test_journals(spark, cited, name, want):
    assert one(spark, biblio.journal_compatible(F.lit(cited), F.lit(name))) is want


def test_contained_journal_and_queries(spark):
    assert one(spark, biblio.journal_contained(F.lit("J. Electroanal. Chem."), F.lit("Journal of Electroanalytical Chemistry and Interfacial Electrochemistry")))
    assert not one(spark, biblio.journal_contained(F.lit("Chem. J."), F.lit("Journal of Chemistry")))
    got = refs(spark, [dict(year=1978), dict(year=1986, volume="56", first_page="4", journal="Phys. Rev. Lett.")]).select(biblio.rescue_query(F.col("ref")).alias("q")).collect()
    assert [r.q for r in got] == [None, "Phys. Rev. Lett. 56 4 1986"]


def test_rescue(spark):
    base = ("10.9/hit", 60.0, 1986, "56", "3", "Physical Review Letters", "A second look at the tide gauge", "journal-article")
    ddl = "doi string, score double, year int, volume string, first_page string, journal string, title string, kind string"
    wrong_page = dict(year=1986, volume="56", first_page="4", journal="Phys. Rev. Lett.")
    flow = "Acoustic sounding methods for the survey of shallow harbour sediments and currents"
    cases = [
        (wrong_page, {}, True), (wrong_page, {"score": 24.0}, False), (wrong_page, {"year": 1990}, False), (wrong_page, {"kind": "book-chapter"}, False),
        (wrong_page, {"volume": "57", "first_page": "9", "journal": "Nature"}, False),
        (dict(text=f"Corrin AB, et al. {flow}. J Harbour Meth 1989; 142: 180."), {"year": 1989, "volume": "125", "first_page": "265", "journal": "Journal of Harbour Methods", "title": flow}, True),
        (dict(text="Z. Ilma, Slow deposition of silt and gravel from rivers into narrow tidal basins, in: 8th International Conference on Estuaries, 2000, p. 293."), {"year": 2000, "volume": "76", "first_page": "2472", "journal": "Applied Physics Letters", "title": "Slow deposition of silt and gravel from rivers into narrow tidal basins"}, False),
        (dict(year=1989, volume="45", first_page="279", journal="Coastal Interact.", text="O. Lund et al., Coastal Interact., 45 /1989/ 279."), {"year": 1989, "volume": "45", "first_page": "277", "journal": "Coastal Interactions", "title": "Chart readings of shoals"}, True),
    ]
    names = ddl.replace(",", "").split()[::2]
    for ref, change, want in cases:
        c = dict(zip(names, base)) | change
        literal = F.struct(*[F.lit(c[n]).cast(t).alias(n) for n, t in zip(names, ddl.replace(",", "").split()[1::2])])
        got = refs(spark, [ref]).select(biblio.rescue_match(F.col("ref"), F.array(literal), 40, 0.8, 1).alias("d")).first().d
        assert (got == "10.9/hit") is want, (ref, change)


def test_final_codes(spark):
    rows = [("A", None, None, None, None), ("B", "success", "x", 1990.0, None), ("B", "fail_no_debit", "x", 1990.0, None), ("B", "open", "x", 1985.0, None), ("B", "open", "x", 1985.0, 1995.0), ("B", "open", None, 1985.0, None)]
    df = spark.createDataFrame(rows, "code string, outcome string, named string, opened double, last double").coalesce(1)
    col = lambda rule: decision.final_code(F.col("code"), F.col("outcome"), F.col("named"), F.col("opened"), F.col("last"), F.lit(2000.0), 10, rule)
    assert [r[0] for r in df.select(col("exclude")).collect()] == ["A", "B_RESOLVED", "B_TO_C", "B_TO_C", "B_OPEN", None]
    assert [r[0] for r in df.select(col("as_named")).collect()][-1] == "B_TO_C"
    with pytest.raises(Exception, match="no tested auxiliary"):
        df.select(col(None)).collect()


def test_readings_of_both_sides(spark):
    def oriented(*pairs):
        return F.array(*[F.struct(F.lit(s).alias("side"), F.lit(r).alias("reading"), F.lit(n).cast("string").alias("note")) for s, r, n in pairs])

    read = lambda *p: tuple(one(spark, decision.primary_reading(oriented(*p))))
    assert read(("p", "S", None), ("not_p", "S", None)) == ("S", "both", None)
    assert read(("p", "A", None), ("not_p", "S", None)) == ("A", "p", None)
    assert read(("p", "A", None), ("not_p", "A", None))[2] == "asymmetric toward both sides"
    assert read(("p", "unclear", "x"), ("not_p", "S", None)) == ("unclear", None, "p: x")


def test_markers():
    assert citations.numbers_of("[3-5, 9]") == {3, 4, 5, 9} and citations.numbers_of("[5-900]") == set() and citations.numbers_of("(12)") == {12}
    single = "The older survey (37) was held to be a careful one although two gauges had failed."
    assert citations.masked_by_author(single, None, None) == (single, False)
    assert citations.masked_by_number(single) == (single.replace("(37)", "[CITED]"), True)
    years = "In the season (2009) of storms (n = 12) the drift (1234) was absent at the gauge in question."
    assert citations.masked_by_number(years) == (years, False)
    several = "Spread in our soundings [11, 12] could reflect a change in the seabed [15] as found before (3)."
    assert citations.masked_by_number(several, {12}, 40) == ("Spread in our soundings [CITED] could reflect a change in the seabed [REF] as found before [REF].", True)
    assert not citations.masked_by_number(several, {12}, 14)[1]
    named = "As Marchal et al. (1988) and (Smith, 1990; Jones and Lee, 1991a) have shown."
    masked, placed = citations.masked_by_author(named, "Marchal", 1988)
    assert placed and masked.startswith("As [CITED] and ([REF]; [REF])")


def test_redaction():
    known = redaction.compiled(redaction.entries([{"terms": ["glacial drift*", "drift"], "names": ["Mara Quill"], "places": ["Norvale"]}, {"organisations": ["drift", "drifter"]}]))
    assert redaction.redacted("Glacial-drifts in norvale by MARA  Quill; drifts, a drift, a drifter.", known) == "[TERM] in the [PLACE] by [NAME]; drifts, a [TERM], a [ORG].".replace("in the", "in")
    assert redaction.redacted("x", redaction.compiled({})) == "x"
    with pytest.raises(ValueError):
        redaction.entries([{"terms": ["*"]}])


def test_html(spark):
    page = "<html><script>var x='<p>';</script><h1>A &amp; B</h1><p>One<br>two</p><ul><li> x   y</li></ul></html>"
    got = values(spark, [(page,)], "h string", text.html_text(F.col("h")))[0]
    assert got == "A & B\n\nOne\n\ntwo\n\nx y"
    refs_page = "<h2>Intro</h2><p>no</p><h2>References</h2><p>Ostrel, K. Tides. J. Tidal Sci. 1:1-2, 1966.</p><p>Venn Q. Salt marsh C. Proc Mar Acad 67, 1643-1648, 1970.</p><h3>About</h3><p>me</p>"
    plain = "<p>Some text.</p><p>References</p><p>Ostrel, K. Long tides measured. J. Tidal Sci. 1:1-2, 1966.</p>"
    got = [r.r for r in spark.createDataFrame([(refs_page,), (plain,), ("<p>nothing</p>",), (None,)], "h string").coalesce(1).select(references.page_references(F.col("h")).alias("r")).collect()]
    assert [(r.year, r.volume, r.first_page) for r in got[0]] == [(1966, "1", "1"), (1970, "67", "1643")]
    assert [(r.year, r.journal) for r in got[1]] == [(1966, "J. Tidal Sci")] and got[2:] == [None, None]


def test_reference_lists():
    lines = ["References", "Smith, J. A first title. Journal of Exam-", "ples 12:34-56. 1990.", "Jones, B. Second. J. Things 3, 4-5, 1991.", "____ 1992. Third by the same. 7:8.", "12", "Appendix", "Brown, C. not this. 1999."]
    got = references.by_starts(references.headed_section(lines))
    assert len(got) == 3 and "Examples" in got[0] and got[2].startswith("Jones, B. Second.") and got[2].endswith("Third by the same. 7:8.")
    numbered = "\n".join(["Body text 1990", "Footer line", "1. One author. 1990.", "Footer line", "2. Two author. 1991.", "3. Three author. 1992.", "Footer line", "4. Four author."])
    assert references.numbered_section(numbered.splitlines()) == ["1. One author. 1990.", "2. Two author. 1991.", "3. Three author. 1992.", "4. Four author."]
    assert references.entries_of("no list here", False) is None


def test_author_lines(spark):
    line = "K. OSTREL, M.D., Ph. D. and E Marchal DMD, MD; Oskar Lund2 et al."
    got = values(spark, [(line,)], "x string", text.authors_of(F.col("x")))[0]
    assert [(a.family, a.given) for a in got] == [("OSTREL", "K."), ("Marchal", "E"), ("Lund", "Oskar")]


def test_abstracts(spark):
    rows = [({"effect": [1], "No": [0], "found": [2], "was": [3, 5], "it": [4]},), ({},), (None,)]
    assert values(spark, rows, "m map<string,array<int>>", text.abstract_text(F.col("m"))) == ["No effect found was it was", None, None]


def test_prose_and_english(spark):
    rows = [("The effect of the treatment on the patients was not found in the trial.",), ("Too short.",), ("12 34 56 a1 b2 c3 d4 e5 f6 word",), ("Der Effekt der Behandlung auf die Patienten ist nicht in der Studie gefunden.",), (None,)]
    df = spark.createDataFrame(rows, "t string").coalesce(1).select(text.is_prose(F.col("t")), text.is_english(F.col("t")))
    assert [tuple(r) for r in df.collect()] == [(True, True), (False, False), (False, False), (True, False), (False, False)]


def test_items_are_merged_and_dropped(spark):
    good = "The effect that was reported by the earlier group [12] has not been seen in this work."
    rows = [("W", "d1", good, "Lee", 1990), ("W", "d2", good, "Lee", 1990), ("W", "d3", "short [1]", None, None), ("W", "d4", good.replace("[12]", "[1] and [2]"), None, None)]
    df = spark.createDataFrame(rows, "cited_work string, source string, text string, family string, year int").selectExpr("*", "cast(null as array<int>) as positions", "cast(null as int) as list_length")
    got = textual.build_items(df, [{"terms": ["group"]}]).collect()
    items = [r for r in got if r.reason is None]
    assert [(list(r.sources), r.rule) for r in items] == [(["d1", "d2"], "citations_v1")]
    assert items[0].text == good.replace("[12]", "[CITED]").replace("group", "[TERM]") and len(items[0].item_id) == 20
    assert sorted((r.reason, tuple(r.sources)) for r in got if r.reason) == [("not_prose", ("d3",)), ("unresolved", ("d4",))]
