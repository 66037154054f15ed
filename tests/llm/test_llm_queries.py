"""The registered queries and the pipeline over the smallest tables."""

import collections

import numpy as np
import pytest
from conftest import SF
from helpers import duck_rows, spark_rows

import corpus_pipeline
from tickloom.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert spark_rows(Q.QUERIES[name](spark, SF)) == duck_rows(duck, Q.ORACLE_SQL[name])


def test_held_out_accuracy(spark, duck):
    sf = SF.replace("0.001", "0.01")
    languages = dict(duck.execute(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    quality = dict(duck.execute(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    rows = [r for r in Q.op9_language_id(spark, sf).collect() if r.held_out]
    assert np.mean([r.lang_pred == languages[r.doc_id] for r in rows]) > 0.97
    rows = [r for r in Q.op8_quality(spark, sf).collect() if r.held_out and r.doc_id in quality]
    assert np.mean([r.predicted == quality[r.doc_id] for r in rows]) > 0.93


def test_pipeline_stage_by_stage(spark, duck):
    """Each stage's rows against what its operator's rule says of its own input."""
    from tickloom.llm.shared import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
            before, after = ({r.doc_id: r.text for r in d.collect()} for d in (docs, out))
            assert set(after) <= set(before)
            if name == "line_dedup":
                assert set(after) == set(before)
                lines = collections.Counter(k for t in after.values() for k in {x.strip(" \t\n\x0b\x0c\r").lower() for x in t.split("\n")} if len(k) >= 20)
                assert max(lines.values()) <= 2
                assert out.where("n_chars <> length(text)").count() == 0
            elif name != "near_duplicates":
                assert all(after[k] == before[k] for k in after)
            docs = out
        sizes.append(out.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    assert out.where("not round_trip").count() == 0 and out.count() == docs.count()
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == out.columns and run.exceptAll(out).count() == 0


def test_pipeline_against_brute_force(spark):
    """What each stage keeps, from plain definitions over its own input."""
    import public_tokenizers
    import tiktoken
    from test_llm_operators import CODEC, brute_components, brute_leak, shingles, words_of

    from tickloom.llm import quality
    from tickloom.llm.shared import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = quality.learn_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bench = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = written(stage(spark, docs, SF), name)
        if name == "quality":
            want = {k: t for k, t in before.items() if net.probability(net.combined(quality.chunk_peaks(net, np.frombuffer((t or "").encode(), np.uint8)))) >= 0.5}
        elif name == "line_dedup":
            key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)}))
            holders: dict = collections.defaultdict(set)
            for k, t in before.items():
                for x in (t or "").split("\n"):
                    holders[key(x)].add(k)
            gone = lambda k, x: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != k
            want = {k: "\n".join(x for x in (t or "").split("\n") if not gone(k, x)) for k, t in before.items()}
        elif name == "near_duplicates":
            sets = {k: shingles(t, 5) for k, t in before.items()}
            root = brute_components(sets, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b))
            want = {k: t for k, t in before.items() if root[k] == k}
            assert len(want) < len(before)
        elif name == "decontamination":
            rare = [{x[i : i + 3] for i in range(len(x) - 2)} for x in (tuple(b) for b in bench)]  # of 13 words, 11 equal: three stand in a row

            def leaks(t: str) -> bool:
                w = words_of(t)
                own = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
                return any(own & r and brute_leak(w, b) for b, r in zip(bench, rare, strict=True))

            want = {k: t for k, t in before.items() if not leaks(t)}
            assert len(want) < len(before)
        else:
            enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
            got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in out.collect()}
            assert got == {k: enc.encode_ordinary(t or "") for k, t in before.items()}
            break
        assert {r.doc_id: r.text for r in out.collect()} == want, name
        docs = out


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Empty tables, and null ids, null texts and repeats in every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels, bench = "doc_id long, quality int, toxic int", "item_id long, text string"
    long = " ".join(f"calm{i} words stand here in order" for i in range(30))
    rows = [(None, None, None, None, None), (None, long, "a", None, 1), (1, long + " x", "a", "s", 1), (1, long + " x", "a", "s", 1), (2, "", None, "s", 0), (3, "word " * 20_000, "b", "s", 1), (4, "$$$ ### " * 50, "b", "s", 1), (5, None, "b", "s", None), (6, "leak of the one item that is here and has some thirteen words or so", "a", "s", 1)]
    for name, own in (("empty", []), ("odd", rows)):
        top = str(tmp_path / name)
        spark.createDataFrame(own, schema).write.parquet(f"{top}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0)] if own else [], labels).write.parquet(f"{top}/labels.parquet")
        spark.createDataFrame([(1, rows[8][1]), (2, None), (None, "x")] if own else [], bench).write.parquet(f"{top}/benchmark.parquet")
        out = corpus_pipeline.run(spark, top)
        assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and out.where("not round_trip").count() == 0
        assert out.count() <= len(own)
        docs = spark.read.parquet(f"{top}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            docs = stage(spark, docs, top)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = [(r.doc_id, r.text) for r in docs.collect()]
        assert (6, rows[8][1]) not in kept and (not own or {(2, ""), (5, "")} <= set(kept)), kept


def test_near_duplicate_stage_keeps_every_text_of_an_id(spark):
    """A third of the ids null and some repeated: what is near nothing stays, one row of each group of copies too."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    rows = [(None if k % 3 == 0 else k // 4, words(k), k) for k in range(40)]
    rows += [(None, words(1), 100), (50, words(0), 101), (None, words(3), 102), (51, words(51), 103), (51, words(51) + " end", 104), (60, None, 105), (60, "", 106), (60, words(60), 107)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3)
    out = corpus_pipeline.no_near_duplicates(spark, df, SF)
    assert out.columns == df.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    want = {(i, t) for i, t, _ in rows[:40] if t != words(1)} | {(None, words(1)), (60, None), (60, ""), (60, words(60))}
    assert len(kept) == len(want) + 1 and want < set(kept) and len({t for i, t in kept if i == 51}) == 1
