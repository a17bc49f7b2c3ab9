import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from framewright.llm import packing

PATH = P.path("word_bpe_49k.json")


def check(rows, docs):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    wanted = Counter((i, np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, x in docs)
    pieces = {}
    for r in rows:
        assert r.length == len(r.ids) // 4
        assert r.ids_crc32 == zlib.crc32(r.ids)
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    got = Counter()
    for (i, n), own in pieces.items():
        own.sort(key=lambda r: r.start)
        while own:  # equal documents have pieces alike
            at, body = 0, b""
            while at < n:
                r = next(x for x in own if x.start == at)
                own.remove(r)
                body += r.ids
                at += r.length
            got[i, body] += 1
    assert got == wanted
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        assert at & (at - 1) == 0  # no padding at all


def test_odd_documents(odd, nothing):
    check(packing.pack(odd, PATH).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack(nothing, PATH).count() == 0


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(2)
    check(packing.pack(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize(("longest", "top"), [(900, 1024), (9000, 2048)])
def test_step_groups_cost_nearly_the_same(longest, top):
    rng, packer = np.random.RandomState(0), packing.Packer(0)
    windows = [w for i in range(3000) for w in packer.add(i, np.zeros(rng.randint(1, longest), np.uint32))] + list(packer.close())
    cost = {}
    for w in windows:
        cost.setdefault(w[0][7], {}).setdefault(w[0][8], []).append(sum(x[2] ** 2 for x in w))
    for tier in sorted(cost):
        groups = list(cost[tier].values())
        assert all(len(v) <= packing.STEP_WINDOWS for v in groups)
        full = [np.mean(v) for v in groups if len(v) >= packing.STEP_WINDOWS - 2]
        if len(groups) > 5:
            assert len(full) > 0.7 * len(groups), tier
        assert not full or tier < 512 or max(full) < 1.3 * min(full), tier
    assert len(cost[top]) > 5


def test_windows_of_long_documents_share_step_groups():
    packer = packing.Packer(0)
    windows = [w for i in range(200) for w in packer.add(i, np.zeros(5000 if i % 2 else 9000, np.uint32))] + list(packer.close())
    sizes = Counter(w[0][8] for w in windows if w[0][7] == 2048)
    assert sum(n >= packing.STEP_WINDOWS - 2 for n in sizes.values()) >= len(sizes) - 1
    assert packer.tokens < packing.BUFFER_TOKENS


def test_long_windows_are_filled_from_shorter_documents(monkeypatch):
    monkeypatch.setattr(packing, "STEP_WINDOWS", 1)
    monkeypatch.setattr(packing, "DEAL_GROUPS", 1)
    packer = packing.Packer(0)
    for n in (1500, 400, 148, 90, 90):
        list(packer.add(n, np.zeros(n, np.uint32)))
    first = next(packer._pack())
    assert sum(x[2] for x in first) in (256, 512, 1024, 2048)
    assert [x[0] for x in first][:2] in ([1500, 400], [400, 90], [148, 90])
