"""Only units that occur again are written, and the spans are those of all units."""

from __future__ import annotations

from driftwatch.llm import substring_dedup


def test_only_repeated_units_are_written(spark, monkeypatch):
    passage = "this passage of words stands in two of the documents and it is long enough to be cut out of the later one " * 2
    texts = [" ".join(f"w{k}x{n}" for n in range(400)) + "." for k in range(6)]
    texts[1] += " " + passage
    texts[4] = passage + texts[4]
    docs = spark.createDataFrame([*enumerate(texts), (None, "lone words here."), (9, None), (9, "")], "doc_id long, text string")
    written, real = {}, substring_dedup.saved

    def counted(df, name):
        out = real(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(substring_dedup, "saved", counted)
    spans = substring_dedup.repeated_spans(docs).collect()
    assert {r.keep_doc_id for r in spans} == {1} and {4} <= {r.doc_id for r in spans} <= {1, 4}
    assert written["units"] < 120  # of more than 500
