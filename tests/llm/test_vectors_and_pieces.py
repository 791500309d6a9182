"""SentencePiece encoding, centroid clustering and hard negatives against the library and brute force, on odd rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from culprit.llm import hilbert_clusters, multi_index, piece_table, queries

sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_table.MODEL))


def check_text(library, text):
    c = piece_table.codec(None)
    ids = [i for some in c.encode_parts(text) for i in some]
    assert ids == library.encode(text), text[:80]
    assert "".join(c.decode_parts([ids])) == library.decode(ids)


def test_pieces_as_the_library(library):
    rng = random.Random(5)
    pieces = list(piece_table.codec(None).pieces.id)
    for _ in range(3000):
        check_text(library, "".join(rng.choice(pieces).replace("▁", " ") for _ in range(rng.randint(1, 8))))
    for _ in range(3000):
        check_text(library, "".join(rng.choice("ab  ▁▁ent\n<s>0x41é中🙂\t\0") for _ in range(rng.randint(0, 50))))
    for n in range(70):
        check_text(library, " " * n + "the" + "▁" * n)


def test_pieces_of_long_texts_do_not_depend_on_parts(library, monkeypatch):
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgh é\n") for _ in range(rng.randint(1, 12))) for _ in range(3000))
    for size in (1, 50, 1000):
        monkeypatch.setattr(piece_table, "CHUNK", size)
        check_text(library, text)
    check_text(library, "ab" * 200_000)
    check_text(library, "x" * 10_000 + " y")


def test_decoding_of_any_ids(library):
    rng = random.Random(7)
    c = piece_table.codec(None)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(260)]) for _ in range(rng.randint(0, 9))]
        cut = rng.randint(0, len(ids))
        assert "".join(c.decode_parts([ids[:cut], ids[cut:]])) == library.decode(ids), ids
    assert piece_table.utf8(b"\xff" * 5000) == "�" * 5000


def test_remembered_pairs_and_words_are_bounded(library, monkeypatch):
    monkeypatch.setattr(piece_table, "MAX_PAIRS", 50)
    monkeypatch.setattr(piece_table, "MAX_WORDS", 20)
    c = piece_table.Codec(public_tokenizers.path(piece_table.MODEL))
    rng = random.Random(8)
    for _ in range(300):
        text = " ".join("".join(rng.choice("etaoins") for _ in range(rng.randint(1, 9))) for _ in range(9))
        assert [i for some in c.encode_parts(text) for i in some] == library.encode(text)
    assert len(c.words) <= 20 and len(c.pieces.together) <= 50


def test_piece_query(spark, edge, library):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op11_piece_table"](spark, edge[0]).collect())
    want = Counter()
    for d, t in edge[1]:
        ids = library.encode(t or "")
        want[d, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode())] += 1
    assert got == want


def test_piece_columns(spark, library):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "text string")
    got = df.select(piece_table.encode(F.col("text")).alias("ids")).select("ids", piece_table.decode(F.col("ids")).alias("back")).collect()
    assert [(r.ids, r.back) for r in got] == [(library.encode("a b"), "a b"), ([], ""), ([], "")]


def table(folder, vectors):
    """Rows of (vec_id, vector, label), with columns whose names the operators use themselves."""
    n = len(vectors)
    columns = {"vec_id": pa.array([r[0] for r in vectors], pa.int64()), "embedding": pa.array([r[1] for r in vectors], pa.list_(pa.float32())), "label": pa.array([r[2] for r in vectors], pa.int32())}
    columns |= {c: pa.array([c] * n, pa.string()) for c in ("v", "i", "q", "n", "cluster", "rank", "part", "low", "score")}
    pq.write_table(pa.table(columns), folder / "embeddings.parquet")
    return str(folder)


def vectors(dims):
    rng = random.Random(dims)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in centres[i % 9]], i % 4) for i in range(420)]
    rows += [(1000 + i, rows[50][1], i % 3) for i in range(200)]  # a third of all rows are one vector
    rows += [(50, rows[50][1], 2), (50, rows[50][1], 2), (50, rows[51][1], 1), (700, [0.0] * dims, 0), (-100, centres[2], 1), (-150, [-x for x in centres[3]], 3)]
    rows += [(701, None, 1), (702, [], 1), (703, [None] + [0.5] * (dims - 1), 1), (704, [float("nan")] * dims, 1), (705, [float("inf")] * dims, 1), (706, [1.0, -2.0], 1), (800, centres[0], None), (None, centres[1], 1), (None, centres[4], 2)]
    return rows


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    m = np.array([v for _, v in kept], np.int64)
    hashed = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    c = np.array([v for _, _, v in hashed[:k]], np.int64)
    for step in range(rounds + 1):
        d = ((m[:, None, :] - c[None, :, :]) ** 2).sum(2)
        own = d.argmin(1)
        if step < rounds:
            c = np.array([m[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else c[j] for j in range(len(c))])
    far = d[np.arange(len(m)), own]
    digest = [sha(",".join(map(str, x)).encode()) for x in c.tolist()]
    return Counter((i, int(o), int(f), int(far[own == o].sum()), int(far.sum()), digest[o]) for (i, _), o, f in zip(kept, own, far, strict=True))


def test_clusters(spark, tmp_path):
    rows = vectors(64)
    got = queries.QUERIES["op12_hilbert_clusters"](spark, table(tmp_path, rows)).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute_clusters(rows)


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_clusters_do_not_depend_on_blocks(spark, tmp_path, size):
    df = hilbert_clusters.kept(spark.read.parquet(table(tmp_path, vectors(64)) + "/embeddings.parquet"))
    blocks = hilbert_clusters.blocks(df, size=size)
    assert blocks.agg(F.max("n")).first()[0] <= size and blocks.agg(F.sum("n")).first()[0] == df.count()
    centroids = hilbert_clusters.lloyd(blocks, hilbert_clusters.first_centroids(df), 10)
    got = hilbert_clusters.assigned(blocks, centroids).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute_clusters(vectors(64))


def test_fewer_vectors_than_centroids_and_large_numbers(spark, tmp_path):
    rows = [(1, [5000.0 + i for i in range(64)], 0), (2, [-60000.0] * 64, 0), (2, [-60000.0] * 64, 0)]
    got = queries.QUERIES["op12_hilbert_clusters"](spark, table(tmp_path, rows)).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute_clusters(rows)


def test_far_boxes_leave_one_candidate():
    centroids = np.array([[0, 0], [100, 0], [0, 100]])
    zone = hilbert_clusters.Zone({"n": 2, "vectors": np.array([[98, 1], [99, 3]], np.int32).tobytes(), "low": [98, 1], "high": [99, 3]}, centroids)
    assert zone.candidates.tolist() == [1] and zone.assign()[2].tolist() == [5, 10]


def test_hilbert_curve_is_a_walk():
    for dims, bits in ((1, 5), (2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = hilbert_clusters.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def brute_negatives(rows):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    width = max(len(v) for _, _, v in kept)
    m = np.array([v + [0] * (width - len(v)) for _, _, v in kept], np.int64)
    out = Counter()
    for a, (i, label, _) in enumerate(kept):
        if math.fmod(i, 50) != 0:
            continue
        ranked = sorted((-int(s), kept[c][0], c) for c, s in enumerate(m @ m[a]) if c != a)
        for p, pos, _ in [r for r in ranked if kept[r[2]][1] == label][:5]:
            inside = [r for r in ranked if kept[r[2]][1] != label and 50 * -p <= 100 * -r[0] <= 95 * -p]
            for n, (s, neg, _) in enumerate(inside[:3], 1):
                out[i, pos, n, neg, -p, -s] += 1
    return out


def found(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("dims", [1, 5, 8])
def test_hard_negatives(spark, tmp_path, dims):
    rows = vectors(dims)
    assert found(queries.QUERIES["op13_multi_index"](spark, table(tmp_path, rows))) == brute_negatives(rows)


def test_hard_negatives_of_small_blocks_stop_early_and_stay_exact(spark, tmp_path, monkeypatch):
    for name, value in (("BLOCK", 8), ("SHARD", 2), ("ANCHORS", 3), ("GROUP", 2), ("CELL", 5)):
        monkeypatch.setattr(multi_index, name, value)
    rows = vectors(6)
    assert found(queries.QUERIES["op13_multi_index"](spark, table(tmp_path, rows))) == brute_negatives(rows)


def test_sums_fall():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=7), rng.normal(size=5)
    got = list(multi_index.falling_sums(a, b))
    assert len({(i, j) for _, i, j in got}) == 35 and all(x[0] >= y[0] for x, y in zip(got, got[1:], strict=False))
    assert all(s == a[i] + b[j] for s, i, j in got) and not list(multi_index.falling_sums(a, b[:0]))


def test_walk_passes_by_cells_that_cannot_matter():
    first, second = np.array([[10.0], [-10.0]]), np.array([[10.0], [-10.0]])
    space = multi_index.Space(2, 20.0, first, second)
    block = {"n": 1, "vectors": np.array([[5, 5]], np.int16).tobytes()}
    windows = multi_index.Windows(block, [{"pos": 0, "w": 0, "low": 50.0, "high": 1000.0}], 1, 3)
    radius = {(i, j): (1.0, 1.0) for i in (0, 1) for j in (0, 1)}
    assert [cell for cell, _ in multi_index.Walk(space, block, windows).cells(radius)] == [(0, 0)]
