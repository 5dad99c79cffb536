"""Token ids against the library, packing against its rules."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from conceptmine.llm import packing, tokens, vec

path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
PARTS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", " ", "  ", "\n", "\t", "a", "Bc", "é", "ß", "1", "22", ".", "!?", " ",
         "\x1c", "\u0085", "中文", "<|endoftext|>", "😀", "'sun", "''s", " 't", "x's ", "don't", "\r\n", "́", "²", "½", "_", "Жы"]


def library(texts):
    from tokenizers import Tokenizer
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_librarys(monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(0, 25))) for _ in range(8000)] + ["", "x" * 9000]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    for room in (tokens.CACHE, 200):
        e, got = tokens.Encoder(path), []
        e._reset(room)
        for part in range(0, len(texts), 1000):
            for _, buf, offsets in vec.slices(batch.slice(part, 1000), "text"):
                ids, bounds = e.encode(buf, offsets)
                got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == library(texts)


def test_sum_of_squares_rule():
    rnd = random.Random(2)
    sizes = np.array([rnd.randrange(1, 12) for _ in range(400)])
    sequence, offset = packing.sum_of_squares(sizes, 12)
    gaps: dict[int, int] = {}
    for s, q, o in zip(sizes.tolist(), sequence.tolist(), offset.tolist()):
        assert o == 12 - gaps.get(q, 12)

        def squares(after):
            count = defaultdict(int)
            for g in after.values():
                count[g] += g > 0
            return sum(c * c for c in count.values())

        chosen = squares({**gaps, q: gaps.get(q, 12) - s})
        others = [squares({**gaps, k: g - s}) for k, g in gaps.items() if g >= s] + [squares({**gaps, -1: 12 - s})]
        assert chosen == min(others)
        gaps[q] = gaps.get(q, 12) - s


def test_pack_round_trip(spark):
    rnd = random.Random(6)
    docs = [(i, " ".join(rnd.choice(["alpha", "beta", "Gamma's", "42", "é"]) for _ in range(rnd.choice([0, 1, 30, 90, 400]))))
            for i in range(120)] + [(500, None), (501, ""), (502, "w " * 3000), (7, "again the same id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, length int")
    rows = packing.pack(df, path, length=128, group=50, keep_ids=True).collect()
    want = sorted((i, tuple(ids + [0])) for (i, _), ids in zip(docs, library([t or "" for _, t in docs])))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, ids in want:
        own = sorted(by_doc[i], key=lambda r: r.piece)
        if i != 7:
            assert tuple(x for r in own for x in r.ids) == ids
            assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
            assert all(r.length == 128 for r in own[1:])
    assert len(by_doc[7]) >= 2
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.05 * total / 128 + 5
    assert packing.pack(df.where("false"), path).count() == 0
