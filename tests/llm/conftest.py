import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = "the of and to stone river market winter green paper window house bread garden letter number silver copper morning evening walked carried opened closed yellow little".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def lines(rng, n):
    return "\n".join(prose(rng, rng.randint(6, 14)) for _ in range(n))


def junk(rng, n):
    return "\n".join(" ".join(w.upper() + "!!***" for w in prose(rng, rng.randint(6, 14)).split()) for _ in range(n))


def documents():
    """Plain, bad, repeated, near, empty, null, long and odd documents; also extra columns with clashing names."""
    rng = random.Random(7)
    rows = [(i, lines(rng, rng.randint(2, 8))) for i in range(0, 60, 2)]
    rows += [(100 + i, junk(rng, 4)) for i in range(20)]
    rows += [(2 * i + 1, rows[i][1]) for i in range(5)]  # copies
    rows += [(201 + i, rows[i][1].replace("the", "a", 1)) for i in range(5)]  # near copies
    shared = lines(rng, 9)
    rows += [(300 + i, lines(rng, 2) + "\n" + shared + "\n" + lines(rng, 2)) for i in range(6)]
    rows += [(400, None), (401, ""), (402, "   \t\n "), (403, "\n\n"), (404, "short"), (405, "12 34 | 56"), (406, "a" * 3000), (407, "ab" * 900 + "\n" + "é漢🙂 " * 40)]
    rows += [(408, lines(rng, 400)), (408, lines(rng, 3)), (409, rows[3][1]), (409, rows[3][1]), (None, lines(rng, 3)), (None, None), (-5, rows[2][1])]
    return rows


def write(folder, docs, labels, pages, vectors, extra=True):
    n = len(docs)
    columns = {
        "doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string()),
        "lang": pa.array([None if i % 17 == 0 else ("en", "xx")["!!***" in (t or "")] for i, (_, t) in enumerate(docs)], pa.string()),
        "source": pa.array([None if i % 13 == 0 else f"s{i % 5 if i % 3 else 0}" for i in range(n)], pa.string()), "n_chars": pa.array([len(t or "") for _, t in docs], pa.int64()),
    }
    if extra:
        columns |= {c: pa.array([f"{c}{i}" for i in range(n)], pa.string()) for c in ("doc", "row", "key", "body", "size", "score", "kept", "component", "copies")}
    pq.write_table(pa.table(columns), folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x for x, _ in labels], pa.int64()), "quality": pa.array([x for _, x in labels], pa.int32()), "toxic": pa.array([0] * len(labels), pa.int32())}), folder / "labels.parquet")
    pq.write_table(pa.table({"page_id": pa.array(range(len(pages)), pa.int64()), "url": pa.array([f"http://x/{i}" for i in range(len(pages))], pa.string()), "html": pa.array(pages, pa.string())}), folder / "pages.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([i for i, _ in vectors], pa.int64()), "embedding": pa.array([v for _, v in vectors], pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())}), folder / "embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def edge(tmp_path_factory):
    rng = random.Random(3)
    docs = documents()
    labels = [(d, int("!!***" not in (t or ""))) for d, t in docs if d is not None and d % 3] + [(None, 1), (0, None), (9999, 0)]
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(90)] + [(100, None), (101, []), (102, [1.0, None]), (103, [float("nan")] * 8), (104, [float("inf")] * 8), (120, [1.0, 2.0]), (121, [0.0] * 8), (None, [1.0] * 8)]
    vectors += [(140 + i, vectors[20][1]) for i in range(4)] + [(20, vectors[20][1])]
    return write(tmp_path_factory.mktemp("edge"), docs, labels, [None, "", "plain", "<p>a, b &amp; c<p>d"], vectors), docs


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [], [], [], [])
