import hashlib
import os
import random
import zlib

import pytest
from edge import ROWS, awkward, empty

from strata.llm import matroska as M
from strata.llm import queries
from strata.llm.common import table

SF = "/root/testdata/sf0.001"


def test_round_trip_and_timestamps():
    r = random.Random(1)
    for n in [64, 512, 576, 4096, 4160, 65536, 65600, 12_800_000] + [64 * r.randint(1, 300) for _ in range(60)]:
        payload = os.urandom(n)
        got = M.read(M.mux(payload))
        assert got.samples() == payload
        assert [p.timestamp for p in got.packets] == [8 * k * 512 // 64 for k in range(-(-n // 512))]
        assert len(got.cues) == len(got.clusters) and dict(got.clusters) == {c.position: c.time for c in got.cues}
        assert all(got.data[p.offset : p.offset + p.size] for p in got.packets)


@pytest.mark.parametrize("seed", range(5))
def test_lacing_and_unknown_sizes(seed):
    r = random.Random(seed)
    for _ in range(40):
        frames = [os.urandom(r.choice([0, 1, 5, 200, 300, 3000, 70000])) for _ in range(r.randint(1, 9))]
        body = M.element(M.CLUSTER, M.uint(M.TIMESTAMP, 5) + M.element(M.SIMPLE_BLOCK, M.block(1, -3, frames)))
        xiph = M.vint(1) + b"\x00\x07\x02" + bytes([len(frames) - 1]) + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1]) + b"".join(frames)
        open_cluster = M._id(M.CLUSTER) + b"\xff" + M.uint(M.TIMESTAMP, 9) + M.element(M.BLOCK_GROUP, M.element(M.BLOCK, xiph))
        got = M.read(M._id(M.SEGMENT) + b"\x01\xff\xff\xff\xff\xff\xff\xff" + open_cluster + body)
        assert [got.data[p.offset : p.offset + p.size] for p in got.packets] == frames * 2
        assert {p.timestamp for p in got.packets} == {16, 2} and {p.cluster for p in got.packets} == {0, 1}


def test_damage_is_told(spark):
    media = M.mux(os.urandom(6400))
    cut = spark.createDataFrame([(1, media), (2, media[:-3000]), (3, None), (4, b""), (5, b"\x00\x01")], "doc_id long, media binary")
    got = M.packets(cut).collect()
    assert len([r for r in got if r.doc_id == 1]) == 13 and all(r.error is None for r in got if r.doc_id == 1)
    assert sum(r.error is not None for r in got if r.doc_id == 2) == 1 and sum(r.error is not None for r in got if r.doc_id == 5) == 1
    assert not [r for r in got if r.doc_id in (3, 4)]


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text.encode() for r in table(spark, SF, "documents").collect()}
    media = {r.doc_id: bytes(r.media) for r in M.store(table(spark, SF, "documents")).collect()}
    for r in queries.op4_matroska(spark, SF).collect():
        t = texts[r.doc_id]
        payload = t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest())


def test_awkward_rows(spark):
    got = M.media_digest(awkward(spark)).collect()
    assert len(got) == len(ROWS) and {r.payload_bytes for r in got if r.doc_id in (2, 3)} == {64}
    assert len({r.media_sha256 for r in got if r.doc_id == 6}) == 1
    assert M.media_digest(empty(spark)).count() == 0
