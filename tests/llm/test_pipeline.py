"""Every stage of the pipeline against brute force on the rows that its predecessor kept, and run() against the stages."""

import random

import public_tokenizers
import pytest

import corpus_pipeline

from . import plain

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    """Clean texts, toxic ones, near copies of two texts, a line that recurs with other numbers, nulls and empty texts."""
    rnd = random.Random(11)
    plain = [f"{a}{b}" for a in ("bar", "den", "fil", "gor", "hum", "jol", "kep", "lin", "mas", "nur") for b in ("a", "en", "o", "ist", "ul", "ek", "am", "iv", "ost", "ib")]
    out, toxic = [], {}
    for i in range(480):
        words = rnd.choices(plain, k=rnd.randint(12, 80))
        toxic[i] = int(i % 4 == 0)
        if toxic[i]:
            for _ in range(3 + len(words) // 10):
                words[rnd.randrange(len(words))] = rnd.choice(["vile", "rotten", "nasty"])
        text = " ".join(words)
        if i % 10 == 3:
            text += f"\nPosted at {i}:{i % 60} by user{i}\n" + " ".join(rnd.choices(plain, k=6))
        out.append((i, text))
    for base in range(2):
        words = rnd.choices(plain, k=90)
        for n in range(20):
            copy = list(words)
            if n % 3:
                copy[rnd.randrange(90)] = f"changed{'abcdefghijklmnopqrst'[n]}"
            out.append((1000 + base * 100 + n, " ".join(copy)))
    out += [(2000, ""), (2001, None), (2002, "   ")]
    return [(i, t, "en" if i % 2 else "de", f"s{i % 3}", None if t is None else len(t)) for i, t in out], toxic


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    documents, toxic = rows()
    spark.createDataFrame(documents, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_and_run(spark, folder):
    import sentencepiece

    documents, toxic = rows()
    given = {r[0]: r for r in documents}
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{n}")
        docs = spark.read.parquet(f"{folder}/stage{n}")
        kept.append({r["doc_id"]: r.asDict() for r in docs.collect()})
        assert docs.count() == len(kept[-1])
        assert n == 4 or docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    scored, lined, single, sampled, encoded = kept
    gone = given.keys() - scored.keys()
    assert sum(toxic.get(i, 0) for i in gone) >= 0.95 * sum(toxic.values()) and sum(not toxic.get(i, 0) for i in gone) <= 0.02 * len(given)
    assert all(tuple(r.values()) == given[i] for i, r in scored.items())
    lines = plain.line_dedup([r["text"] for r in scored.values()])
    want = {i: None if r["text"] is None else lines[r["text"]][0] for i, r in scored.items()}
    assert {i: r["text"] for i, r in lined.items()} == want and any(want[i] != scored[i]["text"] for i in want)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in lined.values())
    root = {i: r for i, (_, r) in plain.near_components([(i, r["text"]) for i, r in lined.items()], 5, 80).items()}
    assert single == {i: lined[i] for i in root if root[i] == i} and {1000, 1100} <= single.keys() and not {1001, 1119} & single.keys()
    assert sampled.items() <= single.items() and len(sampled) >= 0.75 * len(single)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {i: (list(r["ids"]), r["decoded"]) for i, r in encoded.items()} == {i: (sp.encode(r["text"] or ""), sp.decode(sp.encode(r["text"] or ""))) for i, r in sampled.items()}
    assert {r["doc_id"]: r.asDict() for r in corpus_pipeline.run(spark, folder).collect()} == encoded


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
