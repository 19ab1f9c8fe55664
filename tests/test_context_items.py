"""Items of whole texts, against a plain-Python version on a small fixture."""

import re

from corvane.plans import catalog

FILLER = "We see that the results of this work are in line with what was found before. " * 8
LATER = FILLER + "It was refuted later on."
DOCS = [(1, "a", FILLER + "This was shown [3] by the rest."), (2, "a", LATER), (3, "b", LATER), (4, "a", LATER), (5, "a", FILLER + "Anble has found the same.")]


def slow_items(docs):
    """One marker is the cited work's; of several none is known to be."""
    items, lost = {}, {}
    for k, source, text in docs:
        text += " as was shown [12] by others."
        if len(set(re.findall(r"\[\d+\]", text))) > 1:
            lost.setdefault((source, "unresolved"), []).append(str(k))
        else:
            items.setdefault((source, text.replace("[12]", "[CITED]")), []).append(str(k))
    return items, lost


def test_items_equal_slow(spark, tmp_path):
    assert len(FILLER) > 400
    spark.createDataFrame(DOCS, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalog.QUERIES["context_items"](spark, str(tmp_path)).collect()
    named = [r for r in rows if "5" in r.sources]
    assert [r.sources for r in named] == [["5"]] and "Anble" not in named[0].text and named[0].text.startswith(FILLER)
    items, lost = slow_items([d for d in DOCS if d[0] != 5])
    assert {(r.cited_work, r.text): r.sources for r in rows if not r.reason and r not in named} == items
    assert {(r.cited_work, r.reason): r.sources for r in rows if r.reason} == lost
