"""Each training-data operator on small tables: odd rows, ties, empty tables, clashing columns, plain versions of the results."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import chat, exact_dedup, fingerprint, html_text, mixing, near_dedup, packing, queries, sharding, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, norm string, digest string, node long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards box in quiet rooms".split()


def frame(spark, texts, sources=None):
    """Documents with further columns whose names clash with the operators' own."""
    rows = [(i, t, "en", (sources or ["a", "b", None])[n % 3] if not callable(sources) else sources(n), len(t or ""), n, "x", "y", 7) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "One "), (6, LONG), (7, LONG + " "), (None, "no id here at all"), (8, "é ü ñ x"), (9, "a  b\tc"), (10, "a b c"), (10, "a b c"), (11, " ".join(WORDS)), (12, " ".join(WORDS) + " end")]


def test_exact_dedup(spark):
    df = frame(spark, ODD)
    got = exact_dedup.exact_duplicates(df, digest_all=True).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in ODD:
        groups[norm(t)].append(i)
    assert len(got) == len(ODD)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_hash[r.digest]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert all(sum(r.kept for r in got if r.digest == h) == 1 for h in by_hash)
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df).collect()) == sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got)
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert {r.doc_id for r in kept.collect()} == {min((i for i in ids if i is not None), default=None) for ids in groups.values()}
    assert exact_dedup.exact_dedup(df.limit(0)).count() == exact_dedup.exact_duplicates(df.limit(0)).count() == 0


def plain_components(texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in texts}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            ra, rb = sorted((root(a), root(b)))
            up[rb] = ra
    return {i: (len(s), root(i)) for i, s in sets.items()}


def crowd(seed, n_bases=6, copies=25):
    """Texts around bases at many distances, so that links lie on both sides of the threshold, and one shared passage."""
    r = np.random.default_rng(seed)
    shared = [f"common{i}" for i in range(60)]
    out = []
    for b in range(n_bases):
        base = [f"b{b}w{i}" for i in range(80)]
        for c in range(copies):
            words = list(base)
            for _ in range(int(r.integers(0, 9))):
                words[int(r.integers(0, len(words)))] = f"z{int(r.integers(0, 10**6))}"
            out.append(" ".join((shared if c % 2 else []) + words))
    order = r.permutation(len(out))
    return [(int(i) * 3 + 5, out[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("seed", [0, 1])
def test_near_dedup_matches_all_pairs(spark, seed):
    texts = crowd(seed) + [(i, t) for i, t in [(1, None), (2, ""), (3, " \n"), (4, "Two words"), (6, "two WORDS"), (9000, LONG), (9001, LONG + " tail"), (9002, "É A b c d e f"), (9003, "é a b c d e f")]]
    texts = list(dict(texts).items())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert got == plain_components(texts)


def test_near_dedup_rows_without_id_and_empty_tables(spark):
    df = frame(spark, ODD)
    rows = near_dedup.near_duplicates(df).collect()
    assert len(rows) == len(ODD)
    kept = near_dedup.near_dedup(df)
    assert kept.columns == df.columns
    gone = {r.doc_id for r in rows if not r.kept}
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i or 0 for i, _ in ODD if i not in gone)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_chunk_keys_find_all_pairs_within_the_signature_distance():
    r = np.random.default_rng(5)
    a = r.integers(0, 65536, near_dedup.SYMBOLS, dtype=np.uint16)
    for errors in (0, 1, 8, near_dedup.CHUNKS, 2 * near_dedup.CHUNKS - 1):
        for _ in range(50):
            b = a.copy()
            b[r.choice(len(a), errors, replace=False)] ^= np.uint16(1)
            keys = near_dedup.chunk_keys(np.stack((a, b)))
            assert set(keys[0]) & set(keys[1])


def test_mixing(spark):
    texts = [(i, " ".join(["w"] * n)) for i, n in enumerate([5, 0, 100, 3, 40, 1, 7, 9, 11, 300, 2, 2])] + [(100, None), (101, "a b c\td")]
    rows = mixing.mix(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(r.source_size == sizes[r.source] for r in rows)
    total = 1.5 * sum(sizes.values())
    assert abs(sum(target.values()) - total) < 1e-6 * total
    assert all(abs(taken[s] - target[s]) <= 0.5 and target[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    # Sources below their cap share by weight 5, 2, 1 in order of name, null last.
    free = [(s, w) for s, w in zip(["a", "b", None], (5, 2, 1)) if target[s] < 2 * sizes[s] - 1e-6]
    assert len({round(target[s] / w, 6) for s, w in free}) <= 1
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(frame(spark, texts)).collect()), key=repr)
    odd = mixing.mix(frame(spark, ODD + [(None, "another without id")] + texts[:3])).collect()  # null and repeated ids, a very long text
    assert len(odd) == len(ODD) + 4 and all(0 <= r.taken <= 2 * r.size for r in odd)
    for source in {r.source for r in odd}:
        own = [r for r in odd if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5 and own[0].source_size == sum(r.size for r in own)
    out = mixing.mixed_documents(frame(spark, texts))
    got = Counter()
    for r in out.collect():
        got[r.source] += len(re.findall(mixing.WORD, r.text or ""))
    assert out.columns == frame(spark, texts).columns and got == +taken
    assert mixing.mix(frame(spark, texts).limit(0)).count() == mixing.mixed_documents(frame(spark, texts).limit(0)).count() == 0


def test_first_words(spark):
    row = spark.sql(r"select ' a\tb  c' as t").select(mixing.first_words(F.col("t"), F.lit(2)).alias("x"), mixing.words(F.col("t")).alias("n")).first()
    assert (row["x"], row["n"]) == (" a\tb", 3)


@pytest.mark.skipif(not os.path.exists(queries.TOKENIZER), reason="no tokenizer file")
def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.TOKENIZER)
    tok.encode_special_tokens = True
    texts = [*ODD, (20, "it's <|endoftext|> twice  spaced\n\n x y "), (21, "x " * 600), (22, "long word " * 500)]
    rows = packing.pack(frame(spark, texts), queries.TOKENIZER, capacity=64).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, t in texts:
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces[i], key=lambda r: r.start)
        copies = sum(j == i for j, _ in texts)
        assert sum(r.length for r in own) == copies * len(want)
        if copies == 1:
            assert [x for r in own for x in np.frombuffer(r.ids, "<u4")] == want
            assert all(r.length == 64 for r in own[1:]) and [r.piece for r in own] == list(range(len(own)))
            assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in own)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.02 * -(-sum(r.length for r in rows) // 64) + 1
    assert packing.pack(frame(spark, ODD).limit(0), queries.TOKENIZER).count() == 0


@pytest.mark.skipif(not os.path.exists(queries.TOKENIZER), reason="no tokenizer file")
def test_packing_queries_take_the_ids_of_the_unmodified_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    tok, end = Tokenizer.from_file(queries.TOKENIZER), "<|endoftext|>"
    texts = [f"it's {end} twice  spaced\n\n x y ", end, f"{end}{end} a", f"a {end}", f"a  {end}  b", f"a\n {end}b{end[:-1]}", f"<|{end}|> {end.upper()}", *(t or "" for _, t in ODD)]
    frame(spark, enumerate(texts)).write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (queries.op2_best_fit_packing(spark, str(tmp_path)).collect(), corpus_pipeline.pack_sequences(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()):
        got = {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in rows}
        want = {}
        for i, t in enumerate(texts):
            ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
            first = len(ids) % 1024 or min(1024, len(ids))
            for low, high in zip([0, *range(first, len(ids), 1024)], [*range(first, len(ids), 1024), len(ids)]):
                want[i, low] = (high - low, zlib.crc32(ids[low:high].tobytes()))
        assert got == want


def test_segments_of_long_texts_join_to_the_text(monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 10)
    for t in (LONG[:500], "a" * 100, "a  b   c " * 20, " " * 50, "x\n y " * 30, ""):
        parts = list(packing.segments(t))
        assert "".join(parts) == t
        assert all(p[0] == " " and not p[1].isspace() for p in parts[1:])


def test_bins_are_no_more_than_first_fit_needs():
    r = np.random.default_rng(1)
    for _ in range(30):
        sizes = Counter(int(x) for x in r.integers(1, 20, 40))
        plan = packing.plan_bins(sizes, 20)
        used = Counter()
        for times, lengths in plan:
            assert sum(lengths) <= 20
            for x in lengths:
                used[x] += times
        assert used == sizes
        room = []  # first fit, longest first
        for x in sorted(sizes.elements(), reverse=True):
            i = next((i for i, free in enumerate(room) if free >= x), len(room))
            room[i : i + 1] = [(room[i] if i < len(room) else 20) - x]
        assert sum(t for t, _ in plan) <= len(room)


def fewest_bins(sizes, capacity):
    """The least number of bins, by trying every way to fill the bin of the largest item left."""
    best = [len(sizes)]

    def search(left, bins):
        if not left:
            best[0] = min(best[0], bins)
        elif bins + -(-sum(left) // capacity) < best[0]:
            top, rest = left[0], left[1:]
            seen = set()
            for n in range(len(rest) + 1):
                for chosen in combinations(range(len(rest)), n):
                    kept = tuple(rest[i] for i in chosen)
                    if top + sum(kept) <= capacity and kept not in seen:
                        seen.add(kept)
                        search([x for i, x in enumerate(rest) if i not in chosen], bins + 1)

    search(sorted(sizes, reverse=True), 0)
    return best[0]


def test_bins_are_close_to_the_fewest():
    r = np.random.default_rng(8)
    found, fewest = 0, 0
    for _ in range(40):
        sizes = [int(x) for x in r.integers(1, 20, 8)]
        own, least = sum(n for n, _ in packing.plan_bins(Counter(sizes), 20)), fewest_bins(sizes, 20)
        assert own <= least + 1
        found, fewest = found + own, fewest + least
    assert found <= 1.05 * fewest


def test_the_fullest_combination_is_found():
    r = np.random.default_rng(9)
    for _ in range(100):
        counts = Counter(int(x) for x in r.integers(1, 15, 6))
        items, target = sorted(counts.elements()), int(r.integers(1, 40))
        most = max(s for n in range(len(items) + 1) for c in combinations(items, n) if (s := sum(c)) <= target)
        got = packing._fill(target, counts)
        assert sum(got) == most and not Counter(got) - counts


def test_sharding(spark):
    r = np.random.default_rng(2)
    texts = [(int(i), " ".join(r.choice(WORDS, int(r.integers(1, 80))))) for i in r.permutation(3000)] + [(5000 + i, "copy of a text") for i in range(400)] + ODD
    rows = sharding.shard(frame(spark, texts), 24).collect()
    assert len(rows) == len(texts)
    slots, sizes, groups = defaultdict(list), Counter(), defaultdict(set)
    for x in rows:
        slots[x.shard].append(x.slot)
        sizes[x.shard] += x.size
        groups[x.text_crc32, x.size].add(x.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    assert all(len(s) == 1 for s in groups.values())
    by_id = {i: t for i, t in texts if (i or 0) > 12}
    assert all(x.size == len((by_id[x.doc_id] or "").encode()) + 8 and x.text_crc32 == zlib.crc32((by_id[x.doc_id] or "").encode()) for x in rows if x.doc_id in by_id)
    assert sharding.shard(frame(spark, ODD).limit(0)).count() == 0
    even = sharding.shard(frame(spark, texts[:3000]), 24).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(even) == 24 and max(e.n for e in even) < 1.06 * min(e.n for e in even)


def plain_shards(texts, shards):
    """The law of the tree on lists: sorted points, running sums, the cut nearest to the goal."""
    weight, first, one = Counter(), {}, {}
    for i, t in texts:
        d = hashlib.md5((t or "").encode()).hexdigest()
        size = len((t or "").encode()) + 8
        weight[d] += size
        first[d] = min(first.get(d, 2**62), -1 if i is None else i)
        one[d] = size
    total = sum(weight.values())
    laid, at = sharding._lay([(d, w) for d, w in weight.items() if w * shards > total], total, shards)
    wants = sharding._wants(laid, total - sum(laid))
    points = {d: ((first[d] + 1 << 20) + int(d[:5], 16), (one[d] + 1 << 20) + int(d[:5], 16), int(d[:15], 16)) for d in weight if d not in at}
    span = lambda ds, k: max(points[d][k] for d in ds) - min(points[d][k] for d in ds)
    whole = [max(1, span(points, k)) for k in range(3)] if points else None

    def split(ds, s):
        if not ds:
            return
        if len(s) == 1:
            at.update(dict.fromkeys(ds, s[0]))
            return
        k = max(range(3), key=lambda k: span(ds, k) / whole[k])
        goal = sum(weight[d] for d in ds) * (sum(wants[i] for i in s[: len(s) // 2]) / (sum(wants[i] for i in s) or 1.0))
        order, run, n = sorted(ds, key=lambda d: points[d][k]), 0, len(ds)
        for j, d in enumerate(order):
            if run + weight[d] >= goal:
                n = j + 1 if run + weight[d] - goal <= goal - run else j
                break
            run += weight[d]
        split(order[:n], s[: len(s) // 2])
        split(order[n:], s[len(s) // 2 :])

    split(list(points), range(shards))
    return weight, at


@pytest.mark.parametrize("spread", [0, 1])
def test_sharding_matches_a_plain_tree(spark, monkeypatch, spread):
    r = np.random.default_rng(4)
    length = (lambda: int(r.integers(1, 60))) if spread == 0 else lambda: int(1 + 900 * r.random() ** 6)
    texts = [(int(i), " ".join(r.choice(WORDS, length()))) for i in r.permutation(900)] + [(2000 + i, "copy of a text") for i in range(40)] + [(None, "x"), (None, None)]
    weight, at = plain_shards(texts, 7)
    monkeypatch.setattr(sharding, "BINS", 300)
    monkeypatch.setattr(sharding, "EVEN", 1e-9)  # the tree alone
    got = {(x.text_crc32, x.size): x.shard for x in sharding.shard(frame(spark, texts), 7).collect()}
    assert got == {(zlib.crc32((t or "").encode()), len((t or "").encode()) + 8): at[hashlib.md5((t or "").encode()).hexdigest()] for _, t in texts}
    # Then what is too uneven is evened out, and hardly anything else moves.
    monkeypatch.setattr(sharding, "EVEN", 40)
    rows = sharding.shard(frame(spark, texts), 7).collect()
    sizes = Counter()
    for x in rows:
        sizes[x.shard] += x.size
    assert max(sizes.values()) - min(sizes.values()) <= sum(sizes.values()) / 7 / 40 + 1
    assert sum(got[x.text_crc32, x.size] != x.shard for x in rows) <= len(rows) / 20


def test_groups_heavier_than_a_shard_lie_apart(spark):
    texts = [(i, f"giant {i} " * 3000) for i in range(2)] + [(100 + i, f"small text number {i}") for i in range(600)]
    sizes, giants = Counter(), set()
    for x in sharding.shard(frame(spark, texts), 6).collect():
        sizes[x.shard] += x.size
        if x.doc_id < 2:
            giants.add(x.shard)
    assert len(giants) == 2
    rest = [sizes[s] for s in range(6) if s not in giants]
    assert max(rest) < 1.1 * min(rest) and all(sizes[s] < 1.01 * (3000 * 8 + 3100) for s in giants)


def test_fingerprints(spark):
    texts = [(i, t) for i, t in ODD if i is not None]
    rows = fingerprint.neighbour_likeness(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    order = sorted(texts, key=lambda x: (x[0], x[1] or ""))
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        own = [r for r in rows if r.doc_id == i]
        assert any(r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() for r in own)
    same = {r.doc_id: r.fingerprint for r in rows}
    assert same[1] == same[2] == "" and same[10] == [r.fingerprint for r in rows if r.doc_id == 10][1]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    far = fingerprint.neighbour_likeness(frame(spark, [(i, " ".join(np.random.default_rng(i).choice(LONG.split()[:900], 400))) for i in range(50)])).collect()
    assert all(r.near_edited > 0.25 for r in far) and np.mean([r.near_next for r in far]) < 0.1
    assert fingerprint.neighbour_likeness(frame(spark, ODD).limit(0)).count() == fingerprint.fingerprints(frame(spark, ODD).limit(0)).count() == 0


def test_fingerprint_buckets_cover_every_neighbour(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET", 3)
    texts = [(i * 7 % 101, f"text number {i} " * (i % 5)) for i in range(60)] + [(None, "no id"), (5, "tie b"), (5, "tie a")]
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = Counter()
    for n, (i, t) in enumerate(order):
        nxt = order[(n + 1) % len(order)][1]
        want[i, hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()] += 1
    rows = fingerprint.neighbour_likeness(frame(spark, texts)).collect()
    assert Counter((r.doc_id, r.edited_sha256) for r in rows) == want


def plain_selection(data, histogram):
    """Selected windows by definition: entropies, ranks and votes one at a time."""
    w, around = fingerprint.WINDOW, fingerprint.AROUND

    def entropy(i):
        counts = Counter(data[i : i + w]).values()
        return min(1000, max(0, round(1000 * (1 - sum(round(1024 * c * math.log2(c)) for c in counts) / round(1024 * w * math.log2(w))))))

    bins = [entropy(i) for i in range(len(data) - w + 1)]
    order = sorted(range(1001), key=lambda b: (b < 250, histogram.get(b, 0), -b))
    rank = {b: i for i, b in enumerate(order)}
    votes = Counter()
    for low in range(1 - around, len(bins)) if bins else ():
        votes[min((i for i in range(max(0, low), min(len(bins), low + around))), key=lambda i: (rank[bins[i]], i))] += 1
    return bins, [i for i in range(len(bins)) if votes[i] >= fingerprint.VOTES]


def plain_likeness(a, b):
    """Of two chains of filters, given as lists of sets of bits."""
    if not a or not b:
        return float(len(a) == len(b))

    def score(x, y):
        most, chance = min(len(x), len(y)), len(x) * len(y) / fingerprint.BITS
        floor = min(chance + max(0.1 * (most - chance), 3 * chance**0.5), most)
        return 1.0 if len(x & y) >= most else min(1.0, max(0.0, (len(x & y) - floor) / max(most - floor, 1e-6)))

    side = lambda p, q: sum(len(x) * max(score(x, y) for y in q) for x in p) / sum(map(len, p))
    return (side(a, b) + side(b, a)) / 2


def test_fingerprints_match_a_plain_version(spark):
    r = np.random.default_rng(6)
    texts = ["a" * 200, "ab" * 100, "-" * 500, "a" * 16, "a" * 40, "short", "", None, "x" * 15, "-" * 60 + " then a sentence of its own " + "=" * 60, *(" ".join(r.choice(WORDS, int(n))) for n in (4, 30, 200, 900))]
    histogram = fingerprint.entropy_histogram(frame(spark, enumerate(texts)))
    want = Counter()
    for t in texts:
        want.update(plain_selection((t or "").encode(), {})[0])
    assert histogram == dict(want)
    ranks = fingerprint.rank_table(histogram)
    chains = []
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        bins, at = plain_selection(bytes(data), histogram)
        assert fingerprint.entropy_bins(data).tolist() == bins and fingerprint.select(np.array(bins, np.int16), ranks).tolist() == at
        chain = fingerprint.filters(data, np.array(bins, np.int16), ranks)
        assert len(chain) == (-(-max(1, len({bytes(data[i : i + 16]) for i in at})) // fingerprint.FEATURES) if len(data) else 0)
        assert bool(len(data)) == bool(chain.any())  # every text but the empty one has a fingerprint
        chains.append(chain)
    sets = [[set(np.flatnonzero(f)) for f in c] for c in chains]
    for x, a in zip(sets, chains):
        for y, b in zip(sets, chains):
            assert abs(plain_likeness(x, y) - fingerprint.likeness(a, b)) < 1e-5
    assert fingerprint.likeness(chains[0], chains[2]) == fingerprint.likeness(chains[0], chains[6]) == 0 and fingerprint.likeness(chains[6], chains[7]) == 1


def test_entropies_don_t_depend_on_blocks(monkeypatch):
    data = np.random.default_rng(0).integers(97, 110, 5000, dtype=np.uint8)
    bins = fingerprint.entropy_bins(data)
    ranks = fingerprint.rank_table(Counter(bins.tolist()))
    at = fingerprint.select(bins, ranks)
    monkeypatch.setattr(fingerprint, "BLOCK", 333)
    assert (fingerprint.entropy_bins(data) == bins).all() and (fingerprint.select(bins, ranks) == at).all()
    left, right = data[:700], data[2000:2600]
    assert (fingerprint.spliced_bins(left, bins, right, fingerprint.entropy_bins(data[2000:])) == fingerprint.entropy_bins(np.concatenate((left, right)))).all()


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, last long")


def test_warc_round_trip(spark, tmp_path):
    r = np.random.default_rng(0)
    noise = "".join(map(chr, r.integers(32, 0x2000, 30_000)))
    htmls = [None, "", "<p>a</p>", "<p>a</p>", "WARC/1.1\r\n\r\nx", noise, noise, "é" * 999] + [f"<p>{i}</p>" * int(r.integers(1, 400)) for i in range(60)]
    rows = [(i, None if i % 9 == 0 else f"http://x/{i}\r\nInjected: yes é", h, "d", 1) for i, h in enumerate(htmls)] + [(3, "u", "<p>a</p>", "d", 1), (None, "u", "alone", "d", 1)]
    archives = warc.write_archives(pages(spark, rows), f"file://{tmp_path}/warc", archive_bytes=6000)
    assert archives.count() > 4 and archives.agg(F.sum("records")).first()[0] == len(rows)
    plain = sorted((x.page_id is None, x.page_id, x.record_type, x.refers_to or -1) for x in warc.read_archives(archives).collect())
    for split in (64, 997, 5000):
        got = warc.read_archives(archives, split_bytes=split).collect()
        assert sorted((x.page_id is None, x.page_id, x.record_type, x.refers_to or -1) for x in got) == plain
    last = {}
    for i, _, h, *_ in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    for x in got:
        h = next((h or "") for i, _, h, *_ in rows if i == x.page_id)
        assert x.payload_bytes == len(h.encode()) and x.payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        respond = x.page_id is None or x.page_id == last[h]
        assert x.record_type == ("response" if respond else "revisit") and x.refers_to == (None if respond else last[h])
        assert x.payload == (h.encode() if respond else None)
    assert warc.read_archives(warc.write_archives(pages(spark, []), f"file://{tmp_path}/none")).count() == 0


def damage(spark, data, path, split):
    """(ids of records, (offset, length) of damaged stretches) of an archive."""
    path.write_bytes(data)
    got = warc.read_archives(spark.createDataFrame([(f"file://{path}", len(data))], "path string, bytes long"), split_bytes=split).collect()
    return sorted(x.page_id for x in got if x.damage is None), sorted((x.offset, x.payload_bytes) for x in got if x.record_type == "damaged")


def test_damaged_archives_lose_nothing_without_a_word(spark, tmp_path):
    r = np.random.default_rng(4)
    members = [warc.record(i, "u", bytes(r.integers(0, 256, 300 + 200 * i, dtype=np.uint8)), None, "d") for i in range(5)]
    at = np.cumsum([0, *map(len, members)]).tolist()
    data, path = b"".join(members), tmp_path / "x.warc.gz"
    flipped = bytearray(data)
    flipped[at[2] + 200] ^= 255
    headless = bytearray(data)
    headless[at[1]] ^= 255
    foreign = data[: at[3]] + b"garbage" + data[at[3] :]
    long_claim = warc.zlib.compressobj(6, warc.zlib.DEFLATED, 31)
    short = long_claim.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nabc") + long_claim.flush()
    for split in (40, 333, 1 << 20):
        assert damage(spark, data, path, split) == ([0, 1, 2, 3, 4], [])
        assert damage(spark, bytes(flipped), path, split) == ([0, 1, 3, 4], [(at[2], len(members[2]))])
        assert damage(spark, bytes(headless), path, split) == ([0, 2, 3, 4], [(at[1], len(members[1]))])
        assert damage(spark, data[:-5], path, split) == ([0, 1, 2, 3], [(at[4], len(members[4]) - 5)])
        assert damage(spark, foreign, path, split) == ([0, 1, 2, 3, 4], [(at[3], 7)])
        assert damage(spark, b"xx" + data, path, split) == ([0, 1, 2, 3, 4], [(0, 2)])
        assert damage(spark, b"no archive at all", path, split) == ([], [(0, 17)])
        assert damage(spark, data + short, path, split)[1] == [(at[5], 35)]
    archives = spark.createDataFrame([(f"file://{path}", path.stat().st_size)], "path string, bytes long")
    with pytest.raises(Exception, match="damaged archive: shorter than its Content-Length"):
        warc.whole(warc.read_archives(archives)).collect()


def test_warc_of_others_is_read(spark, tmp_path):
    import gzip

    sha = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\n\r\n"
    raw = lambda head, block: b"\r\n".join([b"WARC/1.0", *head, b"content-length: %d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n"
    records = [
        raw([b"WARC-Type: warcinfo", b"WARC-Record-ID: <urn:uuid:1>", b"Content-Type: application/warc-fields"], b"software: x\r\n"),
        raw([b"warc-type:response", b"WARC-RECORD-ID: <urn:uuid:2>", b"WARC-Target-URI: http://x/a\r\n b", b"Content-Type: application/http; msgtype=response"], http + b"<p>a</p>\r\n\r\nb"),
        raw([b"WARC-Type: response", b"WARC-Record-ID: <urn:uuid:3>", b"WARC-Payload-Digest: sha1:" + sha(b"no").encode(), b"Content-Type: application/http"], http + b"c"),
        raw([b"WARC-Type: revisit", b"WARC-Record-ID: <urn:uuid:4>", b"WARC-Refers-To: <urn:uuid:3>", b"Content-Type: application/http"], http),
        raw([b"WARC-Type: metadata", b"WARC-Record-ID: <urn:uuid:5>"], b""),
        raw([b"WARC-Type: response", b"WARC-Record-ID: <urn:page:7>", b"WARC-Payload-Digest: sha1:" + sha(b"d").encode(), b"Content-Type: application/http"], http + b"d"),
    ]
    members = [gzip.compress(records[0]), gzip.compress(records[1] + records[2]), *map(gzip.compress, records[3:])]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    archives = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", sum(map(len, members)))], "path string, bytes long")
    for split in (50, 10**6):
        got = {x.record_id: x for x in warc.read_archives(archives, split_bytes=split).collect()}
        assert [got[f"<urn:uuid:{i}>"].record_type for i in range(1, 6)] == ["warcinfo", "response", "response", "revisit", "metadata"]
        assert got["<urn:uuid:1>"].payload == b"software: x\r\n" and got["<urn:uuid:5>"].payload == b""
        two, three, four, page = (got[x] for x in ("<urn:uuid:2>", "<urn:uuid:3>", "<urn:uuid:4>", "<urn:page:7>"))
        assert (two.payload, two.payload_digest, two.digest_ok, two.target_uri) == (b"<p>a</p>\r\n\r\nb", sha(b"<p>a</p>\r\n\r\nb"), None, "http://x/a b")
        assert three.digest_ok is False and four.payload is None and four.payload_bytes is None and four.page_id is None
        assert (page.page_id, page.digest_ok, page.payload) == (7, True, b"d")


def test_chat_round_trip(spark):
    nasty = ["", None, "\\", "a\\b", "</turn>", "<</turn>", "<turn </turn>\n", "### User: ### Assistant:", "x\\</turn>\\", r"\### Assistant: </turn> ok", "<|im_end|><|im_start|>", "\n>\n"]
    rows = [(n % 4, n, ["user", "assistant", "system", None, "odd>\nrole\\"][n % 5], t, 1) for n, t in enumerate(nasty * 2)] + [(9, 0, "user", LONG, 1), (9, 1, "assistant", LONG, 1), (9, 1, "assistant", "tie", 1), (None, 0, "user", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position long")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    by = defaultdict(list)
    for c, n, role, t, _ in rows:
        by[c].append((n, role or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    pattern = chat._escaper(chat.DEFAULT)
    for t in nasty[2:]:
        assert not any(c in chat.escape(t, pattern) for c in chat.DEFAULT.controls())
    assert not got[9].valid and got[0].valid == all(r.valid for r in chat.format_turns(df).collect() if r.conv_id == 0)
    valid = {(r.conv_id, r.position): r.valid for r in chat.format_turns(df).collect()}
    assert valid[9, 0] and valid[9, 1] and not valid[9, 2]
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><div id="header"><a href=x>Home</a></div><div class="cookie-notice">We use cookies, a lot of them, on all our pages.</div>
<div class="wrap"><div class="{c}"><h1>A  title</h1><p>First &amp; long enough <b>paragraph<br>with</b> a <a href="z">link</a> and many more words to be content.<p>Second para &lt;b&gt; here, with some more words in it.
<div class="advert">Buy now!</div><ul><li>One item<li>Two items</ul></div><div class="sidebar"><a href=1>Rel one</a><a href=2>Rel two</a></div></div>
<div id="comments"><p>Reader comment with a lot of words, longer than the article perhaps, going on and on without any end at all, and even more.</p></div><footer>(c)</footer>"""
TEXT = "A title\n\nFirst & long enough paragraph with a link and many more words to be content.\n\nSecond para <b> here, with some more words in it.\n\nOne item\n\nTwo items"


def test_html_extraction(spark):
    rows = [(1, "u", PAGE.format(c="content"), "d", 1), (2, "u", None, "d", 1), (3, "u", "", "d", 1), (4, "u", "plain text", "d", 1), (5, None, "<p>" + "word " * 100_000, "d", 1), (6, "u", "<div>" * 3000 + "deep", "d", 1), (7, "u", "<a href='x", "d", 1), (7, "u", "<nav>only menu</nav>", "d", 1)]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.main_text(pages(spark, rows)).collect())
    texts = [t for _, t, _ in got]
    assert texts[0] == TEXT and texts[1] == texts[2] == "" and texts[3] == "plain text" and len(texts[4]) == 5 * 100_000 - 1 and texts[5] == "deep"
    assert all(len(t) == n for _, t, n in got)
    assert html_text.main_text(pages(spark, [])).count() == 0


def test_html_article_of_the_test_pages(spark):
    import html as h

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        body = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1)>", "\0", body).replace("<br>", " "))
        assert html_text.extract(r.html) == "\n\n".join(x for x in (" ".join(h.unescape(b).split()) for b in body.split("\0")) if x)


def plain_density(chars, tags, link_chars, link_tags, page_links, page_chars):
    """The formula of composite text density, as published."""
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * max(1, link_chars) + page_links / max(1, page_chars) * chars + math.e)
    return max(0.0, chars / max(1, tags) * math.log(max(1.0, chars / max(1, link_chars) * max(1, tags) / max(1, link_tags))) / math.log(base))


def test_html_densities_match_a_plain_count():
    import xml.etree.ElementTree as E

    r = np.random.default_rng(3)

    def grow(depth):
        text = lambda: " ".join(["letters"] * int(r.integers(0, 12)))
        tag = str(r.choice(["div", "section", "a", "b", "span"] if depth else ["a", "b", "h2"]))
        inner = "".join(text() + grow(depth - 1) for _ in range(int(r.integers(0, 4)))) if depth else ""
        return f"<{tag}>{inner}{text()}</{tag}>"

    for _ in range(60):
        page = "<body>" + "".join(grow(3) for _ in range(3)) + "</body>"
        plain = E.fromstring(page)
        letters = lambda e: len("".join(e.itertext()).replace(" ", ""))

        def links(e, inside=False):
            inside = inside or e.tag == "a"
            own = (len((e.text or "").replace(" ", "")) if inside else 0) + sum(links(c, inside) + (len((c.tail or "").replace(" ", "")) if inside else 0) for c in e)
            return own

        def count(e, kinds):
            return sum(d.tag in kinds for d in e.iter() if d is not e)

        all_links, all_chars = links(plain), letters(plain)
        density = lambda e: plain_density(letters(e), count(e, {"div", "section", "a", "h2"}), links(e), count(e, {"a"}) + (e.tag == "a"), all_links, all_chars)
        body = html_text._Builder(page).root.children[0]
        nodes = html_text._nodes(body)
        html_text._measure(nodes)
        for e, node in zip(plain.iter(), nodes, strict=True):
            assert e.tag == node.tag and abs(density(e) - node.density) < 1e-9
            runs = [len(x.replace(" ", "")) for x in [e.text or "", *(c.tail or "" for c in e)]]
            own = sum(plain_density(n, 1, n * (e.tag == "a"), 1, all_links, all_chars) for n in runs)
            assert abs(sum(map(density, e)) + own - node.total) < 1e-6


def test_html_pages_without_article_or_main():
    para = lambda x, n=30: f"<p>{(x * 9 + ' ') * n}</p>"
    text = lambda x, n=30: " ".join([x * 9] * n)
    links = "<ul>" + "".join(f"<li><a href={i}>See also number {i}</a>" for i in range(20)) + "</ul>"
    assert html_text.extract(f"<body>{links}<div><h1>Title</h1>{para('a')}{para('b', 3)}</div>{links}</body>") == f"Title\n\n{text('a')}\n\n{text('b', 3)}"
    # The densest part decides, not an article element that holds a teaser.
    assert html_text.extract(f"<body><article><a href=x>More</a> of it</article><div>{para('a')}{para('b')}</div></body>") == f"{text('a')}\n\n{text('b')}"
    # A heading before a section belongs to it, though it is short; lists of links between sections don't.
    assert html_text.extract(f"<body><h2>One</h2><div>{para('a')}{para('b')}</div>{links}<h2>Two</h2><div>{para('c')}{para('d')}</div></body>") == "\n\n".join(["One", text("a"), text("b"), "Two", text("c"), text("d")])


@pytest.mark.parametrize("name", ["related-work", "share", "social-history", "notice-of-terms", "navigational-aids", "commented", "adobe", "header-files"])
def test_html_prose_in_blocks_with_telling_names_is_kept(name):
    page = f"<body><article><p>{'word ' * 60}</p><div class={name}><p>{'prose ' * 40}</p></div></article></body>"
    assert html_text.extract(page) == "\n\n".join([" ".join(["word"] * 60), " ".join(["prose"] * 40)])


@pytest.mark.parametrize("name", ["notice", "cookie-notice", "site-footer", "sidebarLeft", "reader-comments", "ad-slot-3", "main_menu", "newsletter-form", "comments-area", "advert"])
def test_html_parts_that_are_no_content_are_left_out(name):
    page = f"<body><div><p>{'word ' * 60}</p><p>{'more ' * 60}</p><div class={name}><p>{'prose ' * 40}</p></div></div></body>"
    assert html_text.extract(page) == "\n\n".join([" ".join(["word"] * 60), " ".join(["more"] * 60)])


def test_html_sibling_sections_are_all_content():
    para = lambda x: f"<p>{(x * 9 + ' ') * 30}</p>"
    section = lambda xs: f"<div>{''.join(map(para, xs))}</div>"
    links = "<div>" + "".join(f"<a href={i}>See also {i}</a>" for i in range(20)) + "</div>"
    text = lambda xs: "\n\n".join(" ".join([x * 9] * 30) for x in xs)
    assert html_text.extract(f"<body><div class=content>{section('abcde')}{section('fghij')}</div></body>") == text("abcdefghij")
    assert html_text.extract(f"<body>{links}{section('abc')}{links}<section>{section('defgh')}</section>{links}</body>") == text("abcdefgh")
    assert html_text.extract(f"<body><article>{para('a')}</article>{links}<article>{section('bc')}</article></body>") == text("abc")


@pytest.mark.parametrize("name", ['class="layout has-sidebar"', 'class="site no-sidebar"', 'class="with-header"', 'id="main-menu-page"', 'class="header"', 'class="page_without_nav"'])
@pytest.mark.parametrize("tag", ["article", "main", "section"])
def test_html_wrappers_named_after_boilerplate(name, tag):
    para = lambda x: f"<p>{(x * 9 + ' ') * 30}</p>"
    text = lambda xs: "\n\n".join(" ".join([x * 9] * 30) for x in xs)
    page = f"<body><div {name}><{tag}>{para('a')}{para('b')}<div class=ad>Buy</div></{tag}><div class=sidebar><p>Other things</p></div></div></body>"
    assert html_text.extract(page) == text("ab")


def test_html_comments_with_articles_of_their_own_are_left_out():
    page = "<body><article><p>" + "word " * 90 + "</p></article><div id=comments class=comments-area><article><p>" + "reply " * 50 + "</p></article></div></body>"
    assert html_text.extract(page) == " ".join(["word"] * 90)


def plain_segments(scores):
    """Maximal segments by definition: recursively the best segment, then both sides of it."""
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    i, j = best[3], best[4]
    return plain_segments(scores[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in plain_segments(scores[j:])]


def test_segments_match_the_definition():
    r = np.random.default_rng(0)
    for _ in range(200):
        scores = [float(x) / 8 for x in r.integers(-30, 25, int(r.integers(0, 14)))]
        if len({sum(scores[:i]) for i in range(len(scores) + 1)}) == len(scores) + 1:  # no ties of sums
            assert [(a, b) for a, b, _ in toxicity.segments(scores)] == [(a, b) for a, b, _ in plain_segments(scores)]


def toxic_texts(n, seed):
    r = np.random.default_rng(seed)
    base = [f"word{i}" for i in range(300)]
    out = []
    for i in range(n):
        words = list(r.choice(base, int(r.integers(5, 200))))
        bad = i % 6 == 0
        if bad:
            for _ in range(int(r.integers(2, 6))):
                words.insert(int(r.integers(0, len(words))), str(r.choice(["vileness", "nastybad", "gutterish"])))
        out.append((i, " ".join(words), bad))
    return out


def test_toxicity(spark):
    rows = toxic_texts(900, 0)
    docs = frame(spark, [(i, t) for i, t, _ in rows] + ODD[:4] + [(None, "x")])
    labels = spark.createDataFrame([(i, 1, int(b)) for i, _, b in rows] + [(5, 0, None), (5, 0, 0), (99_999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows) + 5
    truth = {i: b for i, _, b in rows}
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id > 4]
    assert held and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    texts = {i: t for i, t, _ in rows}
    for r in held:
        for p in r.passages:
            assert 0 <= p.start < p.end <= len(texts[r.doc_id])
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in got if r.predicted}
    assert kept.count() == sum(r.doc_id not in gone for r in got)
    none = toxicity.learn(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(docs, none).collect()} <= {toxicity.Model({}).score(0)}
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def plain_model(rows):
    """Log-odds, lambda and K of labelled texts, by plain loops over all tokens."""
    n, counts = Counter(), defaultdict(Counter)
    for text, toxic in rows:
        n[toxic] += 1
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        for w in words | {"~" + w[:k] for w in words for k in (4, 5, 6, 7, 8) if len(w) > k}:
            counts[w][toxic] += 1
    weights = {}
    for w, c in counts.items():
        if c[0] + c[1] < toxicity.MIN_DOCS:
            continue
        prior = toxicity.PRIOR * (c[0] + c[1]) / (n[0] + n[1])
        yes, no = [c[x] + prior for x in (1, 0)], [n[x] + toxicity.PRIOR - c[x] - prior for x in (1, 0)]
        if min(no) <= 0:
            continue
        delta = math.log(yes[0] / no[0]) - math.log(yes[1] / no[1])
        if abs(delta) / math.sqrt(sum(1 / x for x in yes + no)) >= toxicity.MIN_Z:
            weights[w] = delta
    gain = lambda w: next((weights[x] for x in [w, *("~" + w[:k] for k in (8, 7, 6, 5, 4) if len(w) > k)] if x in weights), 0.0)
    scores, tops = Counter(), Counter()
    for text, toxic in rows:
        if not toxic:
            words = re.findall(r"[^\W\d_]+", text.lower())
            gains = [gain(w) for w in words]
            scores.update(round((g - toxicity.DRIFT) * 8) / 8 for g in gains)
            tops.update(int(toxicity.once(words[x:y], gains[x:y], s)) for x, y, s in toxicity.segments([g - toxicity.DRIFT for g in gains]))
    total, step = sum(scores.values()), 1e-4
    lam = step
    while sum(c * math.exp(lam * s) for s, c in scores.items()) / total < 1:
        lam += step
    large = sorted(x for x in tops.elements() if x >= 1)
    k = 0.1
    if len(large) >= 20:
        level = next(x for x in sorted(set(large)) if sum(y > x for y in large) <= len(large) / 2) + 1
        above = sum(y >= level for y in large)
        k = min(1.0, max(1e-6, above / (total * math.exp(-lam * level)))) if above else k
    return weights, lam, k, gain


def test_toxicity_matches_a_plain_model(spark):
    r = np.random.default_rng(11)
    rows = [(i, t + (" gutterish " * 2 + "word3" if i % 17 == 3 else ""), bad) for i, t, bad in toxic_texts(1500, 4)]
    rows += [(5000 + j, rows[0][1], rows[0][2]) for j in range(3)]  # repeated texts
    rows += [(6000, " ".join(r.choice([f"word{i}" for i in range(300)], 30_000)) + " vileness nastybad gutterish vileness nastybad", True), (6001, "", False)]
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in rows], "doc_id long, toxic int")
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(6002, None), (6000, "a second row of this id")])
    model = toxicity.learn(docs.filter("text not like 'a second%'"), labels)
    train = [(t, int(b)) for i, t, b in rows if zlib.crc32(str(i).encode()) % 5]
    weights, lam, k, gain = plain_model(train)
    assert weights.keys() == model.weights.keys() and all(abs(weights[w] - model.weights[w]) < 1e-9 for w in weights)
    assert abs(lam - model.lam) < 1e-3 and abs(math.log(k / model.k)) < 0.05
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows) + 2
    texts = {i: t for i, t, _ in rows}
    for x in got:
        text = texts.get(x.doc_id, "") if x.doc_id != 6000 or x.evidence else ""
        words = re.findall(r"[^\W\d_]+", text.lower())
        gains = [gain(w) for w in words]
        limit, best = math.log(max(model.k * len(words), 1e-9)), {}
        for a, b, s in toxicity.segments([g - toxicity.DRIFT for g in gains]):
            z = model.lam * toxicity.once(words[a:b], gains[a:b], s) - limit
            same = frozenset(w for w, g in zip(words[a:b], gains[a:b]) if g > 0)
            if z > 0:
                best[same] = max(z, best.get(same, 0))
        assert abs(sum(best.values()) - x.evidence) < 1e-6
        assert abs(1 / (1 + math.exp(-model.intercept - model.slope * math.log1p(x.evidence))) - x.score) < 1e-6
        assert all(p.significance > -math.log(toxicity.EXPECTED) for p in x.passages)
    long_one = [x for x in got if x.doc_id == 6000 and x.evidence]
    assert len(long_one) == 1 and long_one[0].predicted == 1


def test_held_out_labels_are_not_learned(spark):
    rows = toxic_texts(400, 1)
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    flip = [(i, 1, int(b) if zlib.crc32(str(i).encode()) % 5 else 1 - int(b)) for i, _, b in rows]
    one = toxicity.learn(docs, spark.createDataFrame([(i, 1, int(b)) for i, _, b in rows], "doc_id long, quality int, toxic int"))
    assert one == toxicity.learn(docs, spark.createDataFrame(flip, "doc_id long, quality int, toxic int"))


def test_words_count_once_inside_a_part():
    r = np.random.default_rng(5)
    for _ in range(400):
        weights = dict(zip("abcdefg", r.choice([-1.5, 0.0, 0.2, 0.8, 2.0, 3.0], 7)))
        words = [str(w) for w in r.choice(list("abcdefg"), int(r.integers(1, 25)))]
        for a, b, s in toxicity.segments([weights[w] - toxicity.DRIFT for w in words]):
            part = words[a:b]
            parts = [part[i:j] for i in range(len(part)) for j in range(i + 1, len(part) + 1)]
            want = max(sum(max(0.0, weights[w]) for w in set(p)) + sum(min(0.0, weights[w]) for w in p) - toxicity.DRIFT * len(p) for p in parts)
            assert abs(toxicity.once(part, [weights[w] for w in part], s) - want) < 1e-9


@pytest.mark.parametrize("between", [400, 20_000])
def test_every_toxic_passage_is_found(spark, between):
    vile = ["vileness", "nastybad", "gutterish", "foulmouth"]
    model = toxicity.Model({w: 4.0 for w in vile} | {"word": -0.5}, 1.0, 0.1, -3.0, 2.0)
    clean = " word" * between
    dense = " ".join(vile)
    texts = [dense + clean + " " + dense, (clean + " ").join(vile) + clean + " " + dense + clean, " ".join([dense] * 3), clean]
    got = {r.doc_id: r for r in toxicity.score_documents(frame(spark, enumerate(texts)), model).collect()}
    spans = {i: [texts[i][p.start : p.end] for p in r.passages] for i, r in got.items()}
    assert spans == {0: [dense, dense], 1: [dense], 2: [texts[2]], 3: []}
    assert [got[i].predicted for i in range(4)] == [1, 1, 1, 0]
    # The second copy is reported but is no further evidence.
    assert abs(got[0].evidence - got[0].passages[0].significance) < 1e-9


@pytest.mark.skipif(not os.path.exists(queries.TOKENIZER), reason="no tokenizer file")
def test_the_pipeline_writes_token_ids(spark):
    import corpus_pipeline

    rows = corpus_pipeline.pack_sequences(spark, frame(spark, ODD), SF).collect()
    assert rows and all(len(r.ids) == 4 * r.length and r.ids_crc32 == zlib.crc32(r.ids) for r in rows)


def plain_targets(sizes):
    """Capped water-filling by rounds: (source: size) to (source: target) with weights 5, 2, 1 and at most twice a source's size."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight, clamped, budget = {x: (5, 2, 1)[i % 3] for i, x in enumerate(order)}, set(), 1.5 * sum(sizes.values())
    while True:
        free = [x for x in order if x not in clamped]
        left = budget - sum(2 * sizes[x] for x in clamped)
        target = {x: 2.0 * sizes[x] for x in clamped} | {x: left * weight[x] / sum(weight[y] for y in free) for x in free}
        over = {x for x in free if target[x] > 2 * sizes[x]}
        if not over:
            return target
        clamped |= over


@pytest.mark.skipif(not os.path.exists(queries.TOKENIZER), reason="no tokenizer file")
def test_pipeline_stages_match_plain_versions(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    rows = toxic_texts(700, 3)
    extra = [(3000 + i, t) for i, (_, t) in enumerate(ODD)] + [(None, "no id here"), (None, None), (4000, rows[1][1] + " "), (4001, rows[2][1] + " one more word"), (4002, rows[1][1])] + [(5000 + i, t) for i, t in crowd(1, 2, 8)]
    docs = frame(spark, [(i, t) for i, t, _ in rows] + extra)
    spark.createDataFrame([(i, 1, int(b)) for i, _, b in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = lambda df: sorted((r.doc_id is None, r.doc_id, r.text or "") for r in df.collect())
    tables, at = [docs], docs
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, at.limit(0), str(tmp_path))
        assert empty.count() == 0, name
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        tables.append(at)
    toxic, exact, near, mixed, packed = tables[1:]
    assert all(x.columns == docs.columns for x in tables[:-1])

    bad = {i for i, _, b in rows if b}
    kept = {r.doc_id for r in toxic.collect()}
    assert len(bad - kept) > 0.95 * len(bad) and len({i for i, _, b in rows if not b} - kept) <= 2 and all(i in kept for i, _ in extra)

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    firsts = {}
    for none, i, t in texts(toxic):
        firsts.setdefault(norm(t), (none, i))
    assert sorted((*v, k) for k, v in firsts.items()) == sorted((none, i, norm(t)) for none, i, t in texts(exact))

    with_id = [(i, t) for none, i, t in texts(exact) if not none]
    gone = {i for i, (_, c) in plain_components(with_id).items() if i != c}
    assert [x for x in texts(near) if not x[0]] == [x for x in texts(exact) if not x[0] and x[1] not in gone]

    sizes, taken = Counter(), Counter()
    for r in near.collect():
        sizes[r.source] += len(re.findall(mixing.WORD, r.text or ""))
    for r in mixed.collect():
        taken[r.source] += len(re.findall(mixing.WORD, r.text or ""))
    target = plain_targets(sizes)
    assert all(abs(taken[x] - target[x]) <= 1 for x in target)

    tok, want, got = Tokenizer.from_file(queries.TOKENIZER), Counter(), Counter()
    for r in mixed.collect():
        want.update([r.doc_id] * (len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1))
    bins = defaultdict(list)
    for r in packed.collect():
        got.update([r.doc_id] * r.length)
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)]).tolist()]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 1024


def test_forms_around_the_page_and_headers_of_articles():
    prose = " ".join(["word"] * 60)
    article = f"<article><header><h1>Its title</h1><p>By one</p></header><p>{prose}</p><p>{prose}</p></article>"
    want = "\n\n".join(["Its title", "By one", prose, prose])
    bar = "<header class=site><h1>Site</h1><a href=1>Home page</a><a href=2>All about us</a></header>"
    search = "<form><p>Search here</p><input name=q></form>"
    assert html_text.extract(f"<body>{bar}{search}{article}</body>") == want
    assert html_text.extract(f"<body><form id=aspnet>{bar}<fieldset>Log in</fieldset>{article}</form></body>") == want
    assert html_text.extract(f"<body><fieldset><div><p>{prose}</p><p>{prose}</p></div></fieldset></body>") == f"{prose}\n\n{prose}"
    assert html_text.extract(f"<body><div><p>{prose}</p><p>{prose}</p></div><form><p>{prose[:100]}</p></form></body>") == f"{prose}\n\n{prose}"
    assert html_text.extract("<body><form><p>Please log in</p><label>Name</label><input></form></body>") == ""
