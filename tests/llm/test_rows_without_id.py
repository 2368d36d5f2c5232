"""Repeated strings in many rows without id, whose texts only their hashes tell apart."""

import numpy as np
import pyarrow as pa
import pytest

from gatewise.llm import repeats, textbytes as tb
from tests.llm import brute
from tests.llm.conftest import pulled

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
SCHEMA = "doc_id bigint, text string"


def _alike_in_18_bits():
    """Long and short texts in pairs that agree in the first 18 bits of their hashes; the long ones share a passage."""
    passage = " ".join(f"passage{k}" for k in range(20))
    long = [f"row {k} " + "x y " * 40 + passage for k in range(3000)]
    short = [f"brief {k} " + "z " * 30 for k in range(3000)]

    def bits(texts):
        data, offsets = tb.texts(pa.array(texts))
        return (tb.word_hashes(data, offsets[:-1], offsets[1:]) >> np.uint64(46)).tolist()

    by_bits = dict(zip(bits(short), short))
    pairs = [(a, by_bits[h]) for h, a in zip(bits(long), long) if h in by_bits][:10]
    assert len(pairs) == 10
    return [(None, t) for pair in pairs for t in pair]


def _same_places():
    """Texts of a few blocks each, so that different texts hold equal bytes at equal places."""
    rng = np.random.default_rng(4)
    blocks = [" ".join(f"{chr(97 + b)}{k * k}" for k in range(n)) + " " for b, n in enumerate((9, 16, 25, 30, 36, 40))]
    return [(None if k % 3 else 7, "".join(blocks[b] for b in rng.integers(0, len(blocks), rng.integers(1, 6)))) for k in range(60)]


@pytest.mark.parametrize("rows", [_alike_in_18_bits(), _same_places()], ids=["hashes", "places"])
def test_rows_without_id(spark, rows):
    got = repeats.repeat_report(spark.createDataFrame(rows, SCHEMA))
    assert pulled(got, *COLUMNS) == sorted(brute.repeats(rows), key=repr)
