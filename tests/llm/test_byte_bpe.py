"""The caches of the byte-pair encoder."""

import random

import pytest

from quillspan.llm import byte_bpe

public = pytest.importorskip("public_tokenizers")


def test_a_worker_encodes_a_piece_once_for_all_its_tasks():
    path = public.path("byte_bpe_50k.tiktoken")
    known = byte_bpe.known_pieces(path)
    ids, written, decoded = known[" zyxwvutsr"]
    assert byte_bpe.known_pieces(path) is known and known[" zyxwvutsr"][0] is ids
    assert decoded == b" zyxwvutsr" and written == " ".join(map(str, ids))


def test_lengths_by_last_bytes_leave_no_token_out():
    table = byte_bpe.prefix_table(public.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(3)
    tokens = list(table.rank)
    pieces = [b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 6))) for _ in range(300)] + [b"", b"a", b"\xff\xfe", b"a" * 300]
    for piece in pieces:
        ids = table.encode(piece)
        assert table.decode(ids) == piece and (ids == table._merge(piece, len(table.rank)) or not piece)
