"""SimHash, fingerprints, passages and top-k against brute force."""

from __future__ import annotations

import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from samples import SF_DIR, rows
from pyspark.sql import functions as F

from tablesmith.llm import common, passages, queries, simhash, sketches, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text: str) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    found = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def plain_components(prints: list[tuple], radius: int = 2) -> dict[int, int]:
    """The smallest id by fingerprint."""
    parent = {f: f for _, f in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = list(parent)
    for i, x in enumerate(known):
        for y in known[:i]:
            if bin(x ^ y).count("1") <= radius:
                parent[root(x)] = root(y)
    least: dict[int, int | None] = {}
    for d, f in prints:
        r = root(f)
        least[r] = min((v for v in (least.get(r), d) if v is not None), default=None)
    return {f: least[root(f)] for f in parent}


def check_simhash(result, docs) -> None:
    prints = [(d, plain_fingerprint(t or "")) for d, t in docs]
    classes = plain_components(prints)
    want = sorted((str(d), f"{f:016x}", str(classes[f])) for d, f in prints)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in result) == want


def test_simhash(spark, documents):
    check_simhash(queries.op10_simhash(spark, SF_DIR).collect(), [(d, t) for d, t, _ in documents])


def test_simhash_odd(odd, empty):
    check_simhash(simhash.near_duplicates(odd).collect(), [(r[0], r[1]) for r in rows()])
    assert simhash.near_duplicates(empty).collect() == []


def test_tree_brings_all_close_pairs_together():
    random = np.random.default_rng(5)
    centres = random.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.uint64(1) << random.integers(0, 64, (300, 20)).astype(np.uint64)
    points = np.unique(np.concatenate((centres, (centres[:, None] ^ flips).ravel(), random.integers(0, 1 << 63, 3000, dtype=np.uint64))))
    for radius in (2, 3, 4):
        tree = simhash.Tree(points[::7], radius)
        assert tree.shards > 4
        homes = {}
        for shard, here in tree.shards_of(points):
            for p in here:
                homes.setdefault(int(p), set()).add(shard)
        for i, x in enumerate(points):
            for y in points[i + 1 :][np.bitwise_count(points[i + 1 :] ^ x) <= radius]:
                assert homes[int(x)] & homes[int(y)]


def test_reach_links_chains():
    points = np.array([0b0, 0b11, 0b1111, 0b111111, 0xFFFF << 40], np.uint64)
    members, roots = simhash.reach(points, 2)
    assert sorted(members) == [0b11, 0b1111, 0b111111] and set(roots) == {0}


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1001 + i) for i in range(50)] + [(7, 7)]
    roots = dict(common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert all(roots[i] == 0 for i in range(101)) and all(roots[1000 + i] == 1000 for i in range(51))


def test_distinct_documents(spark, odd, empty):
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    near = words.copy()
    near[200] = "changed"
    far = [w + "x" for w in words]
    docs = spark.createDataFrame([(5, " ".join(words), 1), (6, " ".join(near), 2), (7, " ".join(far), 3), (4, " ".join(words), 4), (8, None, 5), (9, "", 6)], "doc_id bigint, text string, row_key int")
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 7, 8]
    assert sorted(str(r.doc_id) for r in simhash.distinct_documents(odd).collect()) == ["1", "3", "6", "7", "8", "8", "9", "None"]
    assert simhash.distinct_documents(empty).collect() == []


def plain_groups(texts: list[str], similarity: float = 0.8) -> list[int]:
    """The first member of each text's group, from all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            shared = len(sets[a] & sets[b])
            if root[a] != root[b] and shared >= similarity * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def versions(rng) -> dict[str, list[str]]:
    """A chain of versions, copies with scattered changes, pages of one template."""
    def word() -> str:
        return f"w{rng.integers(50_000)}"

    def changed(words: list[str], n: int) -> list[str]:
        out = list(words)
        for at in rng.choice(len(out), n, replace=False):
            out[at] = word()
        return out

    base = [word() for _ in range(200)]
    chain = [base]
    for _ in range(120):
        chain.append(changed(chain[-1], 2))
    template = [word() for _ in range(300)]
    return {
        "chain": [" ".join(w) for w in chain],
        "copies": [" ".join(changed(base, int(rng.integers(3, 10)))) for _ in range(120)],
        "template": [" ".join(template + [word() for _ in range(rng.integers(20, 60))]) for _ in range(80)],
    }


def test_similar_finds_what_all_pairs_find(spark):
    texts = [t for group in versions(np.random.default_rng(5)).values() for t in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    members = docs.select("node", F.array_distinct(sketches.shingle_hashes(F.col("text"), 5)).alias("set"))
    found = {r.node: r.root for r in common.components(simhash._similar(members, 0.8)).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == plain_groups(texts)


def test_near_copies_are_not_compared_pair_by_pair(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 200)]
    texts = []
    for i in range(120):
        words = base.copy()
        words[int(rng.integers(200))] = f"changed{i}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    members = docs.select("node", F.array_distinct(sketches.shingle_hashes(F.col("text"), 5)).alias("set"))
    verified, compared = simhash._verified, []
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    found = {r.node: r.root for r in common.components(simhash._similar(members, 0.8)).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == plain_groups(texts)
    assert sum(compared) <= 15 * len(texts)  # all pairs would be 60 for each text


def test_company_is_what_all_pairs_say_and_sends_each_value_as_often_however_many(spark):
    rng = np.random.default_rng(9)
    points = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for _ in range(6):
        copies = rng.choice(points, 150)
        for _ in range(5):
            copies ^= np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)
        points = np.concatenate((points, copies))
    crowd = points[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    points = np.unique(np.concatenate((points, crowd)))
    want = points[(np.bitwise_count(points[:, None] ^ points[None]) <= 4).sum(1) > 1].view(np.int64).tolist()
    rows = [(seed, f) for f in points.view(np.int64).tolist() for seed in (0, 3)] + [(5, want[0])]
    found = simhash.company(spark.createDataFrame(rows, "seed int, f bigint").repartition(7), 4).distinct().collect()
    assert sorted((r.seed, r.f) for r in found) == sorted((seed, f) for f in want for seed in (0, 3))
    assert simhash.company(spark.createDataFrame([], "seed int, f bigint"), 4).collect() == []
    assert [len(simhash._blocks(radius)) for radius in (2, 4)] == [4, 6]


def test_keys_are_whole_where_batches_are_cut(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 10)
    keys = np.sort(np.random.default_rng(3).integers(0, 9, 200))
    keys[60:140] = keys[60]
    keys = np.sort(keys)
    table = pa.table({"k": keys, "f": np.arange(200)})
    parts = list(simhash._whole_keys(iter(table.to_batches(max_chunksize=7)), ("k", "f")))
    assert np.concatenate([f for _, f in parts]).tolist() == list(range(200)) and len(parts) > 2
    seen = [set(k.tolist()) for k, _ in parts]
    assert all(not (a & b) for i, a in enumerate(seen) for b in seen[i + 1 :])


def test_word_fingerprints_and_shingles_of_many_texts_at_once(monkeypatch):
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 7)
    texts = ["a b c d e f g h", None, "", "b a", " x\ty ", "a b c d e a b c d e a b c d e", " ".join(f"w{i}" for i in range(40))]
    values, sizes = simhash.word_shingles(pa.array(texts), 5)
    assert sizes.tolist() == [4, 0, 0, 1, 1, 5, 36] and len(set(values.tolist())) == len(values) - 1  # "a b c d e" is in two texts
    hashes, count = common.word_hashes(pa.array(texts))
    hashes, sizes = simhash._distinct_of(hashes, np.repeat(np.arange(len(count)), count), len(count))
    assert sizes.tolist() == [8, 0, 0, 2, 2, 5, 40]
    ends = np.cumsum(sizes)
    want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[e - n : e]) > n) for e, n in zip(ends, sizes)]
    assert simhash._majorities(hashes, sizes).tolist() == want


def template_pages(n: int) -> list[str]:
    """Texts of 340 words that share a passage of 60 and nothing else."""
    rng = np.random.default_rng(n)
    passage = " ".join(f"p{i}" for i in range(60))
    return [" ".join([*(f"w{x}" for x in rng.integers(0, 1 << 40, 280)), passage]) for _ in range(n)]


def test_a_shared_passage_makes_no_pairs(spark):
    for n in (300, 1200):
        docs = spark.createDataFrame(list(enumerate(template_pages(n))), "node long, text string")
        sets = docs.select("node", F.array_distinct(sketches.shingle_hashes(F.col("text"), 5)).alias("set"))
        frequencies = spark.sparkContext.broadcast(simhash._frequencies(sets))
        rows = simhash._prefixes(sets, 0.8, frequencies)
        pairs = rows.groupBy("shingle").agg((F.count("*") * (F.count("*") - 1) / 2).alias("pairs")).agg(F.sum("pairs")).first()[0]
        assert pairs <= n / 10
        assert simhash._similar(sets, 0.8).count() == 0


def edited(words: list[str], kind: str, other: list[str], share: float) -> list[str]:
    n = int(len(words) * share)
    at = len(words) // 3
    return {"cut": words[: len(words) - n], "appended": words + other[:n], "replaced": words[:at] + other[: n // 2] + words[at + n // 2 :]}[kind]


def test_distinct_documents_reach_blocks(spark):
    rng = np.random.default_rng(6)
    base = [[f"w{i}" for i in rng.integers(0, 20_000, rng.integers(60, 600))] for _ in range(90)]
    kinds = ["cut", "appended", "replaced"]
    texts = [" ".join(w) for w in base] + [" ".join(edited(w, kinds[i % 3], base[i - 1] * 10, 0.16)) for i, w in enumerate(base)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = plain_groups(texts)
    assert sum(g != i for i, g in enumerate(groups)) > 80
    assert sorted(r.doc_id for r in simhash.distinct_documents(docs).collect()) == sorted(set(groups))


def plain_sketch(text: str, scale: int = sketches.SCALE) -> list[int]:
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text.lower())]

    def chained(part: list[int]) -> int:
        seed = 42
        for h in part:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        return seed

    found = {chained(hashes[i : i + 5]) for i in range(max(1, len(hashes) - 4))} if hashes else set()
    below = sorted(h for h in found if h < (1 << 64) // scale)
    return below or ([min(found)] if found else [])


def alike(a: list[int], b: list[int]) -> float:
    return len(set(a) & set(b)) / min(len(a), len(b)) if a and b else float(not a and not b)


def check_sketches(result, docs) -> None:
    want = []
    for i, (d, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        one, two, three = plain_sketch(text), plain_sketch(edited), plain_sketch(following)
        digits = ["".join(f"{h:016x}" for h in x) for x in (one, two)]
        want.append((str(d), len(text), hashlib.sha256(edited.encode()).hexdigest(), *digits, alike(one, two), alike(one, three)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in result]
    assert sorted(got) == sorted(want)


def test_fingerprints(spark, documents):
    check_sketches(queries.op5_fingerprints(spark, SF_DIR).collect(), [(d, t) for d, t, _ in documents])


def test_fingerprints_odd(odd, empty):
    def key(row):
        named = f"{'' if row[0] is None else row[0]}:{row[1] or ''}"
        return (row[0] is not None, row[0] or 0, hashlib.md5(named.encode()).hexdigest())

    docs = [(r[0], r[1] or "") for r in sorted(rows(), key=key)]
    check_sketches(sketches.edited_fingerprints(odd).collect(), docs)
    assert sketches.edited_fingerprints(empty).collect() == []


def test_sketches_merge(spark):
    parts = ("a b c d e f g h i j k l m n o p", "q r s t u v w x y z", "one two")
    row = spark.createDataFrame([parts], "a string, b string, c string")
    for left, right in (("a", "b"), ("a", "c"), ("c", "b")):
        both = row.select(
            sketches.merged(sketches.sketch(F.col(left)), sketches.sketch(F.col(right))).alias("m"),
            F.array_union(sketches.shingle_hashes(F.col(left)), sketches.shingle_hashes(F.col(right))).alias("all"),
        ).first()
        whole = {h % (1 << 64) for h in both["all"]}
        below = sorted(h for h in whole if h < (1 << 64) // sketches.SCALE)
        assert sorted(h % (1 << 64) for h in both["m"]) == (below or [min(whole)])


def plain_sentences(text: str) -> list[tuple[int, int, list[str], int]]:
    """(start, end, words, weight), character by character."""
    found, start, at = [], 0, 0
    while at <= len(text):
        stop = at
        if at < len(text) and text[at] == "\n":
            while stop < len(text) and text[stop] == "\n":
                stop += 1
        elif at and (text[at - 1] in "。！？" or text[at - 1] in ".!?" and text[at : at + 1].isspace()):
            while stop < len(text) and text[stop].isspace() and text[stop] != "\n":
                stop += 1
        elif at < len(text):
            at += 1
            continue
        words = text[start:at].lower().split()
        wide = [sum(any(low <= c <= high for low, high in (("\u3040", "\u30ff"), ("\u3400", "\u9fff"), ("\uf900", "\ufaff"))) for c in w) for w in words]
        if words:
            found.append((start, at, words, len(words) + sum(n // 2 for n in wide)))
        start, at = stop, max(stop, at + 1)
    return found


def plain_units(text: str, least: int = 6) -> list[tuple[int, int, str]]:
    sentences = plain_sentences(text)
    # None for a long sentence or none at all
    digests = [None, *(xxhash.xxh3_64_intdigest(" ".join(s[2])) if s[3] < least else None for s in sentences), None]
    found, run = [], []
    for i, sentence in enumerate(sentences):
        before, own, after = digests[i : i + 3]
        run.append(sentence)
        least_of_three = None not in (before, own, after) and own < before and own < after
        if own is None or after is None or least_of_three and sum(s[3] for s in run) >= least:
            found.append(run)
            run = []
    return [(r[0][0], r[-1][1], " ".join(w for s in r for w in s[2])) for r in found if sum(s[3] for s in r) >= least]


def plain_repeats(docs) -> set[tuple]:
    seen, want = {}, set()
    for d, text in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        for start, end, words in plain_units(text or ""):
            first = seen.setdefault(words, (d, start))
            if first != (d, start):
                want.add((d, start, end, *first))
    return want


def check_passages(result, docs) -> None:
    assert {tuple(r) for r in result} == plain_repeats(docs)


def test_passages_of_short_and_unspaced_sentences(spark):
    short = " ".join(f"Word{i} goes here." for i in range(18))
    wide = "这是一个很长的句子没有空格。另一句。短句。"
    texts = ["", short, "Hi. " + short, short.replace(". ", ".\n"), wide, "。" + wide, "One. Two.", "One. Two.", "a. \n b。 \n\n", "x.\n" * 50, "x.\n" * 50]
    docs = list(enumerate(texts))
    found = passages.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check_passages(found, docs)
    gone = {d: sum(r.end - r.start for r in found if r.doc_id == d) for d in range(len(texts))}
    assert gone[2] > 0.7 * len(short) and gone[3] > 0.9 * len(short) and gone[5] > 0 and gone[10] > 0 and gone[7] == 0


def test_passages_cleaned_query(spark, documents):
    texts = {d: t or "" for d, t, _ in documents}
    assert len(texts) == len(documents)
    spans = {}
    for d, start, end, *_ in plain_repeats(texts.items()):
        spans.setdefault(d, []).append((start, end))
    want = set()
    for d, text in texts.items():
        rest = text
        for start, end in sorted(spans.get(d, []), reverse=True):
            rest = rest[:start] + rest[end:]
        want.add((d, len(spans.get(d, [])), len(rest), hashlib.sha256(rest.encode()).hexdigest()))
    assert {tuple(r) for r in queries.op6_passages_cleaned(spark, SF_DIR).collect()} == want


def test_passages(spark, documents):
    check_passages(queries.op6_passages(spark, SF_DIR).collect(), [(d, t) for d, t, _ in documents])


def test_passages_odd(spark, odd, empty):
    docs = spark.createDataFrame([(1, "Zero. This is a passage of more than six words. End"), (2, "Some other\nAnd THIS is a   passage of more than six words. no."), (3, "x. This is a Passage of more than six words.\tThis is a passage of more than six words.")], "doc_id long, text string")
    found = passages.repeats(docs).collect()
    assert {(r.doc_id, r.start, r.end, r.first_doc_id) for r in found} == {(3, 3, 44, 1), (3, 45, 86, 1)}
    cleaned = {r.doc_id: (r.text, r.removed) for r in passages.cleaned(docs).collect()}
    assert cleaned[1] == ("Zero. This is a passage of more than six words. End", []) and cleaned[3][0] == "x. \t"
    assert passages.repeats(empty).collect() == []
    kept = passages.cleaned(odd)
    assert kept.columns == [*odd.columns, "removed"] and kept.count() == odd.count()


@pytest.mark.parametrize("block", [7, 4096])
def test_topk_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "VECTORS_PER_BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 3)
    monkeypatch.setattr(topk, "RUN", 4)
    random = np.random.default_rng(3)
    table = [(i, [float(x) for x in random.normal(size=6) * random.uniform(0.01, 3)]) for i in range(120)]
    table += [(200, table[3][1]), (201, table[3][1]), (250, None), (251, [1.0, None]), (252, [float("nan")]), (253, [float("inf")]), (300, [2.0, 1.0]), (350, []), (None, [1.0] * 6)]
    docs = spark.createDataFrame([(i, v, 1) for i, v in table], "vec_id long, embedding array<float>, place int")
    rows_of = {i: [int(np.floor(np.float32(x).astype(float) * 256)) for x in v] for i, v in table if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in rows_of if i is not None and i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(rows_of[q], v)), i is None, i or 0) for i, v in rows_of.items() if i != q)
        want |= {(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(scores[:5], 1)}
    got = topk.largest_products(docs, F.col("vec_id") % 50 == 0)
    assert {tuple(r) for r in got.collect()} == want
    assert topk.largest_products(docs.where("false"), F.col("vec_id") % 50 == 0).collect() == []


def test_counts_of_shingles_take_little_memory(monkeypatch):
    made = np.random.default_rng(4).integers(-(1 << 62), 1 << 62, 1 << 20)
    monkeypatch.setattr(simhash, "SET_VALUES", 1 << 16)
    sets = pa.ListArray.from_arrays(pa.array(np.arange(0, len(made) + 1, 256), pa.int32()), pa.array(made))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(sets))), sets], ["node", "set"])
    grouped = pa.total_allocated_bytes()
    tracemalloc.start()
    found, most = 0, 0
    for part in simhash._counts(iter([batch])):
        found += sum(part.column("n").to_pylist()) if part.num_rows else 0
        most = max(most, pa.total_allocated_bytes() - grouped)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == len(made) and peak < 20 << 20 and most < 4 << 20  # the table itself takes 8 MB


def test_near_dedup_hands_over_few_sets_at_once(spark, monkeypatch):
    name, seen, similar = "spark.sql.execution.arrow.maxRecordsPerBatch", [], simhash._similar
    before = spark.conf.get(name)
    monkeypatch.setattr(simhash, "_similar", lambda *args: seen.append(spark.conf.get(name)) or similar(*args))
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "something else")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.distinct_documents(docs).collect()) == [1, 3]
    assert seen == [str(simhash.ROWS_AT_ONCE)] and spark.conf.get(name) == before and simhash.ROWS_AT_ONCE < int(before)
