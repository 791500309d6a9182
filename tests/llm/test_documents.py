"""The queries on documents against brute force, on odd rows (see conftest)."""

import base64
import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from culprit.llm import bpe_transducer, entropy_mix, line_dedup, quality_crf, queries, simhash_trie, spotsigs, suffix_dedup

sha = lambda b: hashlib.sha256(b).hexdigest()
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
order = lambda d: -(2**63) if d is None else d


def rows(spark, name, edge):
    return queries.QUERIES[name](spark, edge[0]).collect()


def test_line_dedup(spark, edge):
    docs = edge[1]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)
    holders = collections.defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            holders[key(x)].add(order(d))
    want = []
    for d, t in docs:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)]) != order(d))]
        want.append((order(d), len(parts), len(parts) - len(kept), sha("\n".join(kept).encode())))
    got = [(order(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in rows(spark, "op2_line_dedup", edge)]
    assert sorted(got) == sorted(want)


def test_hot_line_over_many_partitions(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "concat('a line that all hold\n', id % 7, ' shared by some of them') as text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["row"]["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: (i > 0) + (i > 6) for i in range(500)}


@pytest.fixture(scope="module")
def reference():
    with open(bpe_transducer.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, edge, reference):
    want = []
    for d, t in edge[1]:
        ids = reference.encode_ordinary(t or "")
        want.append((order(d), len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    got = [(order(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, "op6_bpe_transducer", edge)]
    assert sorted(got) == sorted(want)


def test_bpe_round_trip_of_odd_texts(reference):
    import random

    codec, rng = bpe_transducer.Codec(bpe_transducer.default_path(), public_tokenizers.PATTERN), random.Random(5)
    texts = ["".join(rng.choice("abcdefgh é漢🙂ñ\n\t '1.,!ABing") for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["x" * 5000, " " * 999, "<|endoftext|>"]
    small = bpe_transducer.CHUNK, bpe_transducer.MAX_STATES, bpe_transducer.MAX_PIECES
    try:
        for limits in (small, (50, 300, 20)):  # chunks, states and pieces run over
            bpe_transducer.CHUNK, bpe_transducer.MAX_STATES, bpe_transducer.MAX_PIECES = limits
            for t in texts:
                ids = b"".join(codec.encode_parts(t))
                assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
                assert codec.decode_text(ids) == t
    finally:
        bpe_transducer.CHUNK, bpe_transducer.MAX_STATES, bpe_transducer.MAX_PIECES = small


def test_utf8_stream():
    data, stream = "aé漢🙂z".encode(), bpe_transducer.Utf8Stream()
    out = [stream.feed(data[i : i + 1]) for i in range(len(data))]
    assert "".join(out) + stream.end() == "aé漢🙂z" and max(map(len, out)) == 1
    assert stream.feed(b"\xf0\x9f") == "" and stream.end() == "�"


def brute_fingerprint(text, words):
    w = (text or "").translate(ASCII_LOWER).encode().split()
    if not w:
        return 0
    k = min(words, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, edge):
    docs = edge[1]
    fp = [brute_fingerprint(t, 4) for _, t in docs]
    group = list(range(len(docs)))
    for i, j in itertools.combinations(range(len(docs)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 4:
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for g, (d, _) in zip(group, docs, strict=True):
        least[g] = min(least.get(g, 1 << 62), order(d))
    got = [(order(r.doc_id), r.fingerprint, order(r.component_id)) for r in rows(spark, "op10_simhash_trie", edge)]
    assert sorted(got) == sorted((order(d), f"{f:016x}", least[g]) for (d, _), f, g in zip(docs, fp, group, strict=True))


@pytest.mark.parametrize("two_sided", [False, True])
def test_close_pairs(two_sided):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = base[rng.integers(0, 60, 900)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64))
    a = np.unique(np.concatenate([base, near]))
    b = np.unique(near[:300] ^ np.uint64(5)) if two_sided else None
    got = {(int(i), int(j)) for x, y in simhash_trie.close_pairs(a, b, 4) for i, j in zip(x, y, strict=True)}
    other = a if b is None else b
    d = np.bitwise_count(a[:, None] ^ other[None, :]) <= 4
    want = {(i, j) for i, j in zip(*np.nonzero(d), strict=True) if two_sided or i < j}
    assert got == want and len(want) > 300


def test_simhash_blocks(spark):
    rng = np.random.default_rng(4)
    values = rng.integers(-(1 << 62), 1 << 62, 300)
    values = np.unique(np.concatenate([values, values ^ 3, values ^ (1 << 40)]))
    classes = spark.createDataFrame([(int(v), i) for i, v in enumerate(values)], "fp bigint, node bigint")
    from culprit.llm.components import components

    whole = {(r.node, r.component) for r in components(simhash_trie.links(classes, 4)).collect()}
    assert whole == {(r.node, r.component) for r in components(simhash_trie.links(classes, 4, block=40)).collect()} and whole


def test_components_of_a_chain_and_a_star(spark):
    from culprit.llm.components import components

    links = [(i, i + 1) for i in range(100, 160)] + [(7, 200 + i) for i in range(50)] + [(5, 5), (300, 301), (300, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {7: 7} | {200 + i: 7 for i in range(50)} | {300: 300, 301: 300}


def test_entropy_mix(spark, edge):
    docs = edge[1]
    source = {i: None if i % 13 == 0 else f"s{i % 5 if i % 3 else 0}" for i in range(len(docs))}
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in docs]
    total = collections.Counter()
    for i, n in enumerate(size):
        total[source[i]] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, free, left = {}, set(names), 1.5 * sum(size)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * total[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2 * total[s]
            left -= want[s]
            free.discard(s)
    got = rows(spark, "op8_entropy_mix", edge)
    assert len(got) == len(docs) and sorted(r.size for r in got) == sorted(size) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    by_target = {r.source_size: r.target for r in got}
    assert {total[s]: round(want[s], 6) for s in names} == {k: round(v, 6) for k, v in by_target.items()}
    taken = collections.Counter()
    for r in got:
        taken[r.source_size] += r.taken
    for s in names:
        # whole copies cannot come nearer than about half of a source's largest document
        assert abs(taken[total[s]] - want[s]) <= 0.02 * want[s] + max(n for i, n in enumerate(size) if source[i] == s) / 2
    again = rows(spark, "op8_entropy_mix", edge)
    assert sorted((order(r.doc_id), r.size, r.taken) for r in got) == sorted((order(r.doc_id), r.size, r.taken) for r in again)


def test_multipliers_solve_the_dual(spark):
    counts = spark.createDataFrame([("a", 10, 50), ("a", 200, 7), ("a", 3000, 1), ("b", 5, 9), ("c", 0, 4), (None, 7, 3)], "source string, size bigint, n bigint")
    total = {"a": 4900, "b": 45, "c": 0, None: 21}
    share = {"a": 1.3, "b": 0.25, "c": 1.0, None: 2.0}
    wanted = spark.createDataFrame([(s, t, share[s] * t) for s, t in total.items()], "source string, source_size bigint, target double")
    found = {r.source: r for r in entropy_mix.multipliers(counts, wanted).collect()}
    for s in ("a", "b"):
        r = found[s]
        got = sum(x["n"] * x["size"] * min(2.0, np.exp(r.multiplier * x["size"] / r["mean"])) for x in counts.collect() if x["source"] == s)
        assert abs(got / (share[s] * total[s]) - 1) < 1e-6
    assert found[None].multiplier is None


def brute_signatures(text):
    marked = "\u0002 " + text.lower().replace("\n", " \u0002 ")
    words = [w for w in re.split(r"[^\w\u0002]+|_", marked) if w]
    anchor = lambda w: w in spotsigs.COMMON or w == "\u0002" or (ord(w[0]) + len(w)) % 16 == 0
    out = set()
    for i, w in enumerate(words):
        if anchor(w) and i + 1 < len(words) and not anchor(words[i + 1]):
            out.add(" ".join([w, *[x for x in words[i + 1 :] if not anchor(x)][:2]]))
    return out


def test_spotsigs(spark, edge):
    docs = sorted(edge[1], key=lambda x: (order(x[0]), 0))
    unique = {d for d, n in collections.Counter(d for d, _ in docs).items() if n == 1}
    got = {order(r.doc_id): r for r in rows(spark, "op1_spotsigs", edge)}
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for (d, t), (e, nxt) in zip(docs, docs[1:], strict=False):
        if d not in unique:
            continue
        t, nxt = t or "", nxt or ""
        r, s = got[order(d)], brute_signatures(t)
        assert (r.n_chars, r.n_signatures, r.fingerprint) == (len(t), len(s), sha("\n".join(sorted(s)).encode())), d
        if e in unique:
            half = len(t) // 2
            edited = t[: len(t) - half] + nxt[:half]
            assert r.edited_sha256 == sha(edited.encode())
            assert r.edited_fingerprint == sha("\n".join(sorted(brute_signatures(edited))).encode())
            assert abs(r.near_edited - jac(s, brute_signatures(edited))) < 1e-9 and abs(r.near_next - jac(s, brute_signatures(nxt))) < 1e-9


def test_spotsigs_successor_of_the_last_and_of_the_only_document(spark):
    for ids in ([3], [5, -(2**62), 2**62, 7]):
        docs = spark.createDataFrame([(i, f"the text number {i} of them") for i in ids], "doc_id bigint, text string")
        got = {r.doc: r.edited_sha256 for r in spotsigs.fingerprinted(docs).collect()}
        text = {i: f"the text number {i} of them" for i in ids}
        following = dict(zip(sorted(ids), sorted(ids)[1:] + sorted(ids)[:1], strict=True))
        for i, t in text.items():
            assert got[i] == sha((t[: len(t) - len(t) // 2] + text[following[i]][: len(t) // 2]).encode())


def test_spotsigs_pairs(spark, edge):
    docs = spark.read.parquet(f"{edge[0]}/documents.parquet").select("doc_id", "text")
    members, links = spotsigs.near_duplicates(docs, 0.5)
    sets = {}
    for _, t in edge[1]:
        s = brute_signatures(t or "")
        sets[sha("\n".join(sorted(s)).encode())] = s
    assert {r.fingerprint for r in members.collect()} == set(sets) and members.count() == len(edge[1])
    want = {frozenset((a, b)) for (a, x), (b, y) in itertools.combinations(sets.items(), 2) if x and y and len(x & y) / len(x | y) >= 0.5}
    got = [frozenset((r.a, r.b)) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def brute_repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        yield np.cumsum(gone)[:-1] > 0


def test_suffix_dedup(spark, edge):
    docs = edge[1]
    texts = [(t or "").encode() for _, t in docs]
    want = []
    for (d, _), t, gone in zip(docs, texts, brute_repeats(texts, 400), strict=True):
        want.append((order(d), len(t), int(gone.sum()), len(suffix_dedup._runs(gone)), sha(np.frombuffer(t, np.uint8)[~gone].tobytes())))
    got = [(order(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, "op9_suffix_dedup", edge)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("how", [{"shard_segments": 2}, {"shard_bytes": 5_000}])
def test_suffix_dedup_over_shards(spark, edge, how):
    docs = [(i, t) for i, (_, t) in enumerate(edge[1])]
    texts = [(t or "").encode() for _, t in docs]
    want = {i: int(g.sum()) for i, g in enumerate(brute_repeats(texts, 60))}
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["row"]["doc_id"]: r["n_removed"] for r in suffix_dedup.without_repeats(table, 60, gram=12, **how).collect()}
    assert got == want


def test_suffix_array():
    rng = np.random.default_rng(1)
    s = np.concatenate([rng.integers(0, 2, 300), [256], rng.integers(0, 2, 200), [257], np.zeros(90, int), [258]]).astype(np.uint16)
    order_, rank = suffix_dedup.suffix_array(s)
    want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert order_.tolist() == want and (rank[order_] == np.arange(len(s))).all()
    lcp = suffix_dedup.common_prefixes(s, order_, rank, np.array([0, 301, 502]), np.array([300, 200, 90]))
    for i in list(range(300)) + list(range(301, 501)) + list(range(502, 592)):
        if rank[i]:
            j = want[rank[i] - 1]
            n = 0
            while i + n < len(s) and j + n < len(s) and s[i + n] == s[j + n]:
                n += 1
            assert lcp[i] == n


def test_quality(spark, edge):
    got = rows(spark, "op3_quality_crf", edge)
    text = collections.defaultdict(list)
    for d, t in edge[1]:
        text[d].append(t or "")
    assert len(got) == len(edge[1])
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id < 400 and len(text[r.doc_id]) == 1:
            assert r.predicted == ("!!***" not in text[r.doc_id][0])


def test_marginals_by_enumeration():
    rng = np.random.default_rng(8)
    model = quality_crf.Model(np.zeros(3), rng.normal(size=(2, 2)))
    unary = rng.normal(size=6) * 2
    weight = np.zeros(6)
    total = 0.0
    for states in itertools.product((0, 1), repeat=6):
        w = np.exp(sum(u * s for u, s in zip(unary, states, strict=True)) + sum(model.moves[a, b] for a, b in zip(states, states[1:], strict=False)))
        total += w
        weight += w * np.array(states)
    assert np.allclose(model.marginals(unary), weight / total)


def test_no_labels_scores_a_half(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    assert quality_crf.train(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")) is None


def test_language(spark, edge):
    got = rows(spark, "op4_language_kernel", edge)
    text = collections.defaultdict(list)
    for d, t in edge[1]:
        text[d].append(t or "")
    assert len(got) == len(edge[1])
    for r in got:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "xx", "und")
        if len(text[r.doc_id]) == 1:
            assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", text[r.doc_id][0]))
