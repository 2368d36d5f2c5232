"""Document operators against plain versions, with edge rows and with splitting forced."""

import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gatewise.llm import decontaminate, jaccard, packing, repeats, ring, secrets, tokencount
from tests.llm import brute
from tests.llm.conftest import DATA, pulled


def _same(frame, columns, want):
    assert pulled(frame, *columns) == sorted(want, key=repr)


SECRETS = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def test_secrets(docs, rows, nothing):
    _same(secrets.secret_report(docs), SECRETS, [(d, *brute.secrets(t)) for d, t in rows])
    assert secrets.secret_report(nothing).count() == 0


def test_ledger_scans_only_what_is_new(docs, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = secrets.update_ledger(docs.where("doc_id < 100"), ledger).count()
    both = secrets.update_ledger(docs, ledger)
    assert both.count() == both.select("_blob").distinct().count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count() > first
    secrets.update_ledger(docs, ledger)
    assert both.count() == docs.sparkSession.read.parquet(ledger).count()
    secrets.update_ledger(docs, ledger, version="2")
    assert docs.sparkSession.read.parquet(ledger).count() == 2 * both.count()


def test_redaction(docs, rows):
    got = dict(pulled(secrets.redact(docs).where("doc_id >= 1018 and doc_id <= 1020"), "doc_id", "text"))
    assert got[1018] == '[REDACTED]" token:x [REDACTED]'
    assert got[1019] == "[REDACTED] [REDACTED] [REDACTED]" and got[1020] == "AKIASHORT deadbeef password=12345"
    assert secrets.redact(docs).count() == len(rows) and secrets.redact(docs).columns == docs.columns


REPEATS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("forms, sort_bytes", [(repeats.FORMS, repeats.SORT_BYTES), (2, 4000)])
def test_repeats(docs, rows, nothing, forms, sort_bytes):
    _same(repeats.repeat_report(docs, forms, sort_bytes), REPEATS, brute.repeats(rows))
    if forms == 2:
        assert repeats.repeat_report(nothing).count() == 0


def test_jaccard(docs, rows, nothing):
    want = [(d, n, None if d is None else c) for d, n, c in brute.jaccard([(-1 if d is None else d, t) for d, t in rows]) for d in [None if d == -1 else d]]
    # Rows without id link with nothing, so they are no bridge either.
    named = {(d, n): c for d, n, c in brute.jaccard([r for r in rows if r[0] is not None])}
    want = [(d, n, None if d is None else named[d, n]) for d, n, _ in want]
    _same(jaccard.near_copies(docs), ("doc_id", "n_shingles", "component_id"), want)
    assert jaccard.near_copies(nothing).count() == 0


WINDOWS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 300])
def test_contamination(spark, docs, rows, nothing, block):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()]
    items += [(900, "one"), (901, "One, two"), (902, None), (903, ""), (904, "same line of a licence text"), (None, "w1x1 w2x2 w3x3"), (0, items[1][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.judge(decontaminate.find_contamination(docs, bench, block))
    found = found.select("doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"), "contaminated")
    _same(found, WINDOWS, brute.contamination(rows, items))
    if block == 300:
        assert decontaminate.contamination_report(nothing, bench).count() == 0
        assert decontaminate.contamination_report(docs, bench.where("false")).where("contaminated").count() == 0


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


PIECES = ("doc_id", "piece", "start", "length", "ids_crc32")


@pytest.mark.parametrize("part", [packing.PARTITION_PIECES, 60])
def test_packing(spark, docs, rows, nothing, part):
    from gatewise.session import written

    table = packing.pack(written(packing.token_pieces(docs), "pieces"), partition_pieces=part).toPandas()
    assert sorted(map(tuple, table[list(PIECES)].astype(object).where(table[list(PIECES)].notna(), None).values.tolist()), key=repr) == sorted(brute.pieces(rows, _tokenizer()), key=repr)
    for _, own in table.sort_values("offset").groupby("sequence_id"):
        assert own["length"].sum() <= 2048 and own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]]
    assert table["sequence_id"].nunique() <= -(-table["length"].sum() // 2048) + (1 if part > 60 else 3)
    if part == 60:
        assert packing.pack_documents(nothing).count() == 0


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, _ = tokencount.read_vocabulary()
    model = models.Unigram([("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)] + pieces, 0, True)
    plain = Tokenizer(model)
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(pattern=__import__("tokenizers").Regex(r"[ \t\n\r\x0b\x0c]+"), behavior="removed"), pre_tokenizers.Metaspace(prepend_scheme="always", split=False)])
    _same(tokencount.token_report(docs), ("doc_id", "n_tokens"), [(d, len(plain.encode(t or "").ids)) for d, t in rows])


@pytest.mark.parametrize("fallback", [True, False])
def test_viterbi_ties_and_unknown_characters(fallback):
    from itertools import product

    from tokenizers import Tokenizer, models

    pieces = [("a", -1.0), ("b", -2.0), ("ab", -3.0), ("aba", -4.0), ("ba", -3.0), ("bb", -5.0)]
    extra = [(f"<0x{b:02X}>", 0.0) for b in range(256)] if fallback else []
    plain = Tokenizer(models.Unigram([("<unk>", 0.0), *extra, *pieces], 0, fallback))
    counter = tokencount.UnigramCounter(pieces, fallback)
    for n in range(1, 7):
        for letters in product("abé", repeat=n):
            word = "".join(letters)
            assert counter.count(word) == len(plain.encode(word).ids), word


@pytest.mark.parametrize("cell_rows", [ring.CELL_ROWS, 2])
def test_ring(docs, rows, nothing, cell_rows):
    data = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 16).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    got = ring.assign(data.unionByName(data.where("doc_id = 1013").select("*").crossJoin(data.sparkSession.range(90)).drop("id")), "doc_id", 7, cell_rows=cell_rows).toPandas()
    assert len(got) == len(rows) + 90
    counts = got.groupby("shard")["slot"].agg(["size", "min", "max", "nunique"])
    assert counts["size"].max() - counts["size"].min() <= 1 and len(counts) == 7
    assert (counts["min"] == 0).all() and (counts["max"] == counts["size"] - 1).all() and (counts["nunique"] == counts["size"]).all()
    want = sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows if d is not None)
    report = ring.shard_report(docs)
    assert pulled(report.where("doc_id is not null"), "doc_id", "size", "text_crc32") == sorted(want, key=repr)
    assert ring.shard_report(nothing).count() == 0


def test_ring_moves_few_keys(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    before = ring.assign(keys, "k", 20).select("k", F.col("shard").alias("old"))
    after = ring.assign(keys, "k", 21).select("k", "shard")
    moved = before.join(after, "k").where("old <> shard").count()
    assert moved < 20_000 * 0.35  # a new numbering would move 95 %
