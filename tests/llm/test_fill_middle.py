"""Fill-in-the-middle against a plain rendering by the expression of the contract."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import fill_middle
from quillspan.llm.textcore import text_bytes

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"
PROSE = " ".join(f"word{i} ñand{i}\nsome{i}  日本{i}" for i in range(400))


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(h[8 * j : 8 * j + 8], 16) for j in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or three % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if four % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    texts = [None, "", " ", "\n\t ", "one", " one", "one ", "<P> kept as it is", "<S", "a<M>b", PROSE, PROSE + " ", "\t" + PROSE, "x" * 30_000, " " * 30_000, "ab " * 20_000, "é", "<<S ><"]
    return [(17 * i + k, t) for k in range(12) for i, t in enumerate(texts)] + [(None, PROSE), (5, PROSE), (5, PROSE)]


def test_equals_the_plain_rendering(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("n", "form", "output", "prefix_chars")})
    found = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows())
    expected = {}
    for doc_id, text in rows():
        expected.setdefault(doc_id, []).append((*plain(doc_id, text), text or ""))
    forms = set()
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) in expected[r.doc_id]
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def pieces_of(texts):
    import pyarrow as pa

    return text_bytes(pa.array(texts))


def test_shared_passages_are_cut_alike_and_counted_once():
    passage = " ".join(f"shared{i * 7919 % 100_003}" for i in range(3000))
    texts = [passage, "some lead " + passage, "another, longer lead of other words " + passage + " and an end"]
    data, offsets = pieces_of(texts)
    memo = fill_middle.Memo()
    cuts = fill_middle.Cuts(data, offsets, memo)
    chunks = [[data[a:b].tobytes() for a, b in zip(cuts.starts, cuts.ends) if offsets[i] <= a < offsets[i + 1]] for i in range(3)]
    assert all(b"".join(c) == t.encode() for c, t in zip(chunks, texts))
    assert len(set(chunks[0]) & set(chunks[1]) & set(chunks[2])) >= len(chunks[0]) - 3
    assert cuts.units.tolist() == [len(UNIT.findall(t)) for t in texts]
    again = fill_middle.Cuts(data, offsets, memo)
    assert memo.hits == len(cuts.starts) and (again.units == cuts.units).all()


def test_a_name_of_other_content_is_not_used():
    data, _ = pieces_of(["a b c d", "xx yyyy"])
    memo = fill_middle.Memo()
    starts, names = np.array([0, 7]), np.array([1, 1], np.uint64)
    first = memo.summaries(data, starts, names)
    assert first.tolist() == [[3, 7, 0, 0], [1, 7, 0, 0]] and memo.summaries(data, starts, names).tolist() == first.tolist()


@pytest.mark.parametrize("most", [0, 600, 1 << 20])
def test_every_cut_at_every_size_of_the_memo(most):
    text = PROSE[:3000] + "  "
    data, offsets = pieces_of(["lead", text, ""])
    cuts = fill_middle.Cuts(data, offsets, fill_middle.Memo(most))
    units = UNIT.findall(text)
    for k in range(len(units) + 1):
        place, points = cuts.after(1, k)
        before = "".join(units[:k])
        assert place - offsets[1] == len(before.encode()) and points == len(before)


def test_long_runs_are_cut_at_the_bound():
    data, offsets = pieces_of(["x" * 50_000, "y"])
    starts = fill_middle.chunk_starts(data, offsets)
    assert np.diff(np.append(starts, len(data))).max() <= fill_middle.CHUNK_MOST and 50_000 in starts
