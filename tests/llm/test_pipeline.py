"""The pipeline, stage by stage, against plain versions; and its registration."""

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from gatewise.llm import decontaminate, quality, secrets
from tests.llm import brute
from tests.llm.conftest import DATA, pulled
from tests.llm.test_documents import _tokenizer


def test_registered():
    names = set(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_stages(spark, docs, rows):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    # quality: what its query predicts decides
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.train(base, labels)
    good = {r.doc_id for r in quality.score_documents(docs, model).where(f"score >= {quality.THRESHOLD}").collect()}
    kept = corpus_pipeline.keep_good(spark, docs, DATA)
    assert kept.columns == docs.columns
    want = [r for r in rows if r[0] in good]
    assert pulled(kept, "doc_id", "text") == sorted(want, key=repr)
    kept.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-test")
    kept = spark.read.parquet(path)
    # one of each group
    comp = {d: c for d, _, c in brute.jaccard([r for r in want if r[0] is not None], 5, 80)}
    want = [r for r in want if r[0] is None or comp[r[0]] == r[0]]
    one = corpus_pipeline.keep_one_of_each_group(spark, kept, DATA)
    assert one.columns == docs.columns and pulled(one, "doc_id", "text") == sorted(want, key=repr)
    # contamination
    dirty = {i for i, r in enumerate(brute.contamination(want, items)) if r[-1]}
    want = [r for i, r in enumerate(want) if i not in dirty]
    clean = corpus_pipeline.drop_contaminated(spark, one, DATA)
    assert clean.columns == docs.columns and pulled(clean, "doc_id", "text") == sorted(want, key=repr)
    # secrets
    def redacted(text):
        if text is None:
            return None
        spans, out, at = brute.secrets(text)[-1], "", 0
        for span in filter(None, spans.split(",")):
            _, a, b = span.split(":")
            if int(a) >= at:
                out += text[at:int(a)] + "[REDACTED]"
            at = max(at, int(b))
        return out + text[at:]

    want = [(d, redacted(t)) for d, t in want]
    safe = corpus_pipeline.redact_secrets(spark, clean, DATA)
    assert safe.columns == docs.columns and pulled(safe, "doc_id", "text") == sorted(want, key=repr)
    # packing
    packed = corpus_pipeline.pack(spark, safe, DATA)
    assert pulled(packed, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(brute.pieces(want, _tokenizer()), key=repr)


def test_columns_by_any_name_pass_unchanged(spark, docs):
    names = ("_found", "_blob", "_at", "walked_at", "_hits", "_words", "_items", "n_words", "hits", "items", "n_hit", "contaminated", "c0", "_version")
    clash = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    for stage in (lambda d: secrets.redact(d), lambda d: decontaminate.drop_contaminated(d, benchmark)):
        got = stage(clash)
        assert got.columns == clash.columns
        assert pulled(got, "doc_id", "text", "n_chars", "n") == pulled(stage(docs), "doc_id", "text", "n_chars", "n")
        for n in names:
            assert [r[0] for r in got.select(n).distinct().collect()] == [f"own {n}"]


def test_findings_appended_twice_count_once(spark, docs, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = secrets.update_ledger(docs, ledger)
    first.write.mode("append").parquet(ledger + "-again")
    spark.read.parquet(ledger + "-again").write.mode("append").parquet(ledger)
    want = pulled(secrets.scan_history(docs, ["doc_id"]), "doc_id", "findings")
    assert pulled(secrets.scan_history(docs, ["doc_id"], ledger=ledger), "doc_id", "findings") == want
    assert secrets.redact(docs, ledger=ledger).count() == docs.count()
