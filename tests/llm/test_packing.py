import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from forgepulse.llm.packing import Packer, Tokens, pack

from .cases import awkward, empty, real

P = pytest.importorskip("public_tokenizers")


def test_round_trip(spark, small):
    path = P.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    for df, size in ((awkward(spark), 1024), (real(spark, small), 1024), (real(spark, small), 64)):
        docs = [(r.doc_id, [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in df.collect()]
        rows = pack(df, path, size).collect()
        seqs, pieces = defaultdict(list), defaultdict(list)
        for r in rows:
            seqs[r.sequence_id].append(r)
            pieces[r.doc_id, r.doc_tokens].append(r)
            assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        fills = []
        for s in seqs.values():
            at = 0
            for r in sorted(s, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            fills.append(at)
        assert max(fills) <= size and sum(fills) == sum(len(i) for _, i in docs)
        assert all(f == size or f & (f - 1) == 0 for f in fills)  # no padding at all
        for doc_id, ids in docs:
            if sum(d == doc_id for d, _ in docs) == 1:
                got = sorted(pieces[doc_id, len(ids)], key=lambda r: r.start)
                assert [x for r in got for x in r.ids] == ids and [r.start for r in got] == [0, *np.cumsum([r.length for r in got])[:-1].tolist()]
    assert pack(empty(spark), path).count() == 0


def test_ids_equal_the_tokenizers():
    path = P.path("byte_bpe_50k.json")
    ours, whole = Tokens(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    plain = [c for c in map(chr, [*range(0x20), *range(0x20, 0x80), *range(0xA0, 0x250), 0x2013, 0x2019, 0x2026, 0x2028, 0x4E2D, 0x1F600])]
    texts = ["".join(rng.choice(plain) for _ in range(200)) for _ in range(300)] + ["it's we'll  \n\n  x <|endoftext|> y", "", " ", "١٢٣ ²½ Ⅷ"]
    texts += ["".join(rng.choice("ab 1.'\nsé") for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert np.frombuffer(ours.ids(t), dtype="<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_level_minimises_the_sum_of_squares():
    packer = Packer(8)
    add = lambda n: list(packer.add([0, 0, b"\0" * (4 * n)]))
    add(3), add(3)  # on one window: 1 at level 6, not 2 at level 3 (4)
    assert packer.counts.tolist() == [0, 0, 0, 0, 0, 0, 1, 0, 0]
    add(5)
    assert packer.counts.tolist() == [0, 0, 0, 0, 0, 1, 1, 0, 0]
    assert [len(p) for _, p in add(3)] == [2]  # closes 5 + 3
    assert packer.counts.tolist() == [0, 0, 0, 0, 0, 0, 1, 0, 0]
