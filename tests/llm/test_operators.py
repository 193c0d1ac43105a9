"""Operators on DataFrames: brute force on a small table, and the odd cases every one of them must take."""

import collections
import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cladeflow.llm import bpe, chat, edits, fingerprints, jaccard, packing, pseudolm, quality, registry, substrings, toxicity
from cladeflow.llm.textops import as_column

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part long, row long, comp long, sig long"
TIKTOKEN = registry.public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = registry.public_tokenizers.path("byte_bpe_50k.json")


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = prose(60)
    texts = [None, "", " \n ", "a", "A a A", "one two three", "one two three four"]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.25 and len(texts) > 20:
            words = (texts[rng.randrange(8, len(texts))] or "x").split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        elif kind < 0.4:
            texts.append(prose(rng.randint(0, 40)) + " " + shared + "\n" + prose(rng.randint(5, 40)))
        else:
            texts.append(prose(rng.choice([3, 12, 30, 80, 300])))
    texts.append(prose(9000))
    texts.append("loop the loop and on we go " * 40)
    rng.shuffle(texts)
    return [(3 * i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 0, 0, 0, 0) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def as_dict(rows, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in rows.collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def likeness(a, b):
    """Of two fingerprints: the share of (distance, k-mer) entries in common."""
    a, b = ({f[k : k + 10] for k in range(0, len(f), 10)} for f in (a, b))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_fingerprint_edits(docs):
    rows = sorted(corpus(), reverse=True)
    names = "n_chars", "edited_sha256", "near_edited", "near_next", "fingerprint", "edited_fingerprint"
    own = {i: fingerprints.Anchors.of([t or ""]).strings()[0] for i, t in rows}
    for rows_per_part in (11, 1, 1000):
        found = as_dict(fingerprints.fingerprint_edits(docs, rows_per_part=rows_per_part), *names)
        assert len(found) == len(rows)
        for k, (i, text) in enumerate(rows):
            after, following = rows[(k + 1) % len(rows)]
            text, following = text or "", following or ""
            changed = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
            other = fingerprints.Anchors.of([changed]).strings()[0]
            near = pytest.approx(likeness(own[i], other)), pytest.approx(likeness(own[i], own[after]))
            assert found[i] == (len(text), sha(changed), *near, own[i], other)


def test_ranges_are_even_and_hold_all_ids(spark):
    import numpy as np

    ids = [*range(0, 10**6, 997), *([5] * 300), -(2**63), 2**63 - 1, None, None]
    table = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for n_parts in (1, 2, 30):
        bounds = fingerprints.range_bounds(table, len(ids), n_parts)
        part = fingerprints._range_of(spark.sparkContext.broadcast(bounds))
        found = table.select("doc_id", part("doc_id").alias("part")).collect()
        for r in found:
            assert r["part"] == (len(bounds) + 1 if r["doc_id"] is None else int((bounds > r["doc_id"]).sum()))
        sizes = collections.Counter(r["part"] for r in found if r["doc_id"] != 5)
        assert n_parts == 1 or max(sizes.values()) < 4 * len(ids) / n_parts
    assert not len(fingerprints.range_bounds(table.where("doc_id is null"), 2, 2)) and isinstance(bounds, np.ndarray)


def test_single_row_follows_itself(spark):
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    r = fingerprints.fingerprint_edits(one).first()
    assert r["edited_sha256"] == sha("abcd" + "ab") and r["near_next"] == 1.0


def test_substring_removal(docs):
    seen, want = set(), {}
    for i, text in corpus():
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        want[i] = (len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g)))
    assert as_dict(substrings.repeats(docs), "n_words", "n_removed", "kept_sha256") == want
    assert sum(w[1] for w in want.values()) > 500


def test_split_anchors_change_nothing(docs, monkeypatch):
    want = as_dict(substrings.repeats(docs), "n_removed", "kept_sha256")
    for split in (1, 2):
        monkeypatch.setattr(substrings, "SPLIT", split)
        monkeypatch.setattr(substrings, "SHARD_WORDS", 500)
        assert as_dict(substrings.repeats(docs), "n_removed", "kept_sha256") == want


def test_removal_without_ids_and_with_clashing_columns(spark):
    words = [" ".join("q%d_%d" % (k, i) for i in range(25)) for k in range(3)]
    rows = [(None, words[0]), (None, words[0]), (None, words[1]), (4, words[1] + " more"), (4, words[2]), (4, words[2]), (9, words[2])]
    names = "doc_id long, text string, firsts int, key int, key_ int, anchor int, bits int, n_chars int"
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, len(t)) for i, t in rows], names).repartition(3)
    # texts without ids come last; rows of one id, or of none and equal texts, are one document
    want = [(None, words[0]), (None, words[0]), (None, ""), (4, words[1] + " more"), (4, words[2]), (4, words[2]), (9, "")]
    found = substrings.remove_repeats(docs)
    assert found.columns == docs.columns
    rows = [tuple(r) for r in found.collect()]
    assert collections.Counter((r[0], r[1]) for r in rows) == collections.Counter(want)
    assert all(r[2:7] == (1, 2, 3, 4, 5) and r[7] == len(r[1]) for r in rows)


def test_fm_index():
    import numpy as np

    rng = random.Random(7)
    rows = [[rng.randint(1, 4) for _ in range(rng.randint(3, 30))] for _ in range(20)]
    flat, first = np.array([x for r in rows for x in r], np.int32), np.cumsum([0, *map(len, rows)])
    places = np.random.default_rng(1).permutation(len(flat))
    for width in (1, 2, 3, 5, 8):
        index = substrings.FMIndex(flat, first, width, places)
        for _ in range(100):
            pattern = [rng.randint(1, 4) for _ in range(rng.randint(1, 6))]
            low, high, matched = index.search(np.array(pattern), np.array([0]), np.array([len(pattern)]))
            count = sum(r[k : k + len(pattern)] == pattern for r in rows for k in range(len(r)))
            assert (high[0] - low[0] if matched[0] == len(pattern) else 0) == count
        at = collections.defaultdict(list)
        for k, r in enumerate(rows):
            for j in range(len(r) - width + 1):
                at[tuple(r[j : j + width])].append(int(first[k]) + j)
        want = {p: min(places[q] for q in own) for own in at.values() if len(own) > 1 for p in own}
        found = {}
        for begin, least in index.reports(flat, first):
            assert not found.keys() & set(begin.tolist())
            found.update(zip(begin.tolist(), least.tolist()))
        assert found == want


def test_index_finds_repeated_windows():
    import numpy as np

    rng = random.Random(8)
    for _ in range(40):
        width, passages = rng.randint(2, 6), []
        for doc in range(rng.randint(1, 8)):
            words = [rng.randint(1, 3) for _ in range(rng.randint(width, 14))]
            passages.append((rng.randint(0, 5), rng.randint(0, 3), words))
        codes = np.array([w * 977 for *_, words in passages for w in words], np.uint64)
        first = np.cumsum([0, *(len(w) for *_, w in passages)])
        docs, starts = np.array([p[0] for p in passages]), np.array([p[1] for p in passages])
        least = {}
        for doc, start, words in passages:
            for j in range(len(words) - width + 1):
                window = tuple(words[j : j + width])
                least[window] = min(least.get(window, (99, 99)), (doc, start + j))
        found = substrings.repeated_windows(codes, first, docs, starts, width)
        for bits, (doc, start, words) in zip(found.tolist(), passages):
            own = [least[tuple(words[j : j + width])] < (doc, start + j) for j in range(len(words) - width + 1)]
            assert [bool(bits >> j & 1) for j in range(len(own))] == own


def brute_components(rows, size=4):
    sets = {}
    for i, text in rows:
        words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed=3):
    """Groups in which links form chains: each member changes one more word of the one before it."""
    rng, rows = random.Random(seed), []
    for size in (6, 9, 14, 25, 60, 200):
        words = ["g%d_%d" % (size, k) for k in range(size)]
        for k in range(14):
            rows.append((1000 + len(rows), " ".join(words)))
            words = list(words)
            words[rng.randrange(size)] = "x%d" % rng.randrange(10**6)
            if k % 5 == 4:
                words.append("tail%d" % k)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [corpus(), near_copies()], ids=["corpus", "chains"])
def test_join_components(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows)
    assert as_dict(jaccard.join_components(docs), "n_shingles", "component_id") == want
    kept = {r["doc_id"] for r in jaccard.keep_one_each(docs).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}
    assert len(set(c for _, c in want.values())) < len(want)


def test_each_component_keeps_one_row(spark):
    def text(k):
        return " ".join("t%d_%d" % (k, i) for i in range(12))

    rows = [
        (3, text(1)), (5, text(1)), (5, text(2)), (5, text(2)),  # id 5 is a copy of 3, and alone with another text
        (None, text(3)), (7, text(3)), (None, text(4)), (None, text(4)), (None, text(5)),
        (None, None), (None, None), (9, " "), (9, " "),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    kept = jaccard.keep_one_each(docs)
    assert kept.columns == docs.columns
    want = [(3, text(1)), (5, text(2)), (7, text(3)), (None, text(4)), (None, text(5)), (None, None), (None, None), (9, " "), (9, " ")]
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter(want)


def test_large_buckets_meet_in_chunks(spark):
    rows = corpus(4, 120) + near_copies(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {i: c for i, (_, c) in brute_components(rows).items()}
    for chunk in (1, 3):
        found, _ = jaccard._components(docs, 4, 85, 100, chunk)
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == want
    for chunks in (1, 2, 4, 8, 16):
        order = jaccard.phases(chunks)
        assert sorted(order) == list(range(chunks))
        met = collections.Counter((min(c, c ^ t), max(c, c ^ t)) for t in order for c in range(chunks))
        assert len(met) == chunks * (chunks + 1) // 2


def test_links_of_rows_without_ids(spark):
    words = ["n%d" % i for i in range(61)]
    other, third = ["m%d" % i for i in range(61)], ["k%d" % i for i in range(61)]
    rows = [
        (7, " ".join(words) + " q"), (None, " ".join(words)), (None, " ".join(words)),
        (None, " ".join(other)), (None, " ".join(other) + " q"),
        (8, " ".join(third)), (8, " ".join(third) + " q"), (3, " ".join(third) + " z"),
    ]
    for own, want in (
        (rows, [(7, 7), (None, 7), (None, 7), (None, None), (None, None), (8, 3), (8, 3), (3, 3)]),
        (rows[3:5], [(None, None)] * 2),
    ):
        docs = spark.createDataFrame(own, "doc_id long, text string").repartition(2)
        found = [(r["doc_id"], r["component_id"]) for r in jaccard.join_components(docs).collect()]
        assert collections.Counter(found) == collections.Counter(want)
    kept = jaccard.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 3 and {(r["doc_id"], r["text"]) for r in kept} >= {(7, rows[0][1]), (3, rows[7][1])}


def test_clashing_class_numbers_change_nothing(spark, monkeypatch):
    import numpy as np

    rows = near_copies(9)[:40]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    members, clashes = jaccard.members_of(docs, 4)
    assert not len(clashes)
    old = {r["doc_id"]: r["cls"] for r in members.collect()}
    clashes = np.sort(np.array(list(old.values())[::2]))
    new = jaccard._members(docs, 4, clashes)
    assert all((old[r["doc_id"]] != r["cls"]) == (old[r["doc_id"]] in clashes) for r in new.collect())
    monkeypatch.setattr(jaccard, "members_of", lambda docs, size: (new, clashes))
    assert as_dict(jaccard.join_components(docs), "n_shingles", "component_id") == brute_components(rows)


def test_signatures_never_miss_a_link():
    import numpy as np

    rng, bands = np.random.default_rng(0), jaccard.Bands()
    for size in [*range(1, 60), 100, 333, 1000]:
        base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        for _ in range(6):
            out, new = rng.integers(0, max(1, size // 8), 2)
            other = np.unique(np.concatenate([base[out:], rng.integers(0, 2**63, new, dtype=np.uint64)]))
            if len(other) and jaccard.linked(base, other, 85, 100) and not np.array_equal(base, other):
                assert np.intersect1d(jaccard.signatures(base, bands), jaccard.signatures(other, bands)).size
                words = min(len(jaccard.sketch(base)), len(jaccard.sketch(other)))
                bits = jaccard.fold(jaccard.sketch(base), words) ^ jaccard.fold(jaccard.sketch(other), words)
                assert np.bitwise_count(bits).sum() <= np.setxor1d(base, other).size <= bands.most(len(base) + len(other))


def test_round_trip(docs):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=registry.public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(TIKTOKEN)), special_tokens={})
    want = {}
    for i, text in corpus():
        ids = library.encode_ordinary(text or "")
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(text or ""))
    assert as_dict(bpe.round_trip(docs, TIKTOKEN), "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert as_dict(bpe.encode(docs, TIKTOKEN).withColumn("n", F.size("ids").cast("long")), "n") == {i: w[:1] for i, w in want.items()}
    counts = as_dict(edits.edited_counts(docs, TIKTOKEN), "n_tokens", "edited_n_tokens", "edited_sha256")
    for i, text in corpus():
        changed = edits.apply_edits(text or "", edits.sample_edits(text or ""))
        assert counts[i] == (want[i][0], len(library.encode_ordinary(changed)), sha(changed))


def test_trees_are_kept_between_jobs(docs):
    counts = as_dict(edits.edited_counts(docs, TIKTOKEN), "n_tokens", "edited_n_tokens", "reencoded_chars")
    trees = edits.count_trees(docs, TIKTOKEN).cache()
    assert as_dict(trees, "n_tokens") == {i: c[:1] for i, c in counts.items()}
    after = edits.edit_trees(trees, TIKTOKEN)
    assert as_dict(after, "n_tokens", "reencoded_chars") == {i: c[1:] for i, c in counts.items()}
    texts = {i: edits.apply_edits(t or "", edits.sample_edits(t or "")) for i, t in corpus()}
    assert as_dict(after, "text") == {i: (t,) for i, t in texts.items()}


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    found = collections.defaultdict(list)
    rows = packing.pack_documents(docs, JSON, capacity=256, block=40).collect()
    for r in rows:
        found[r["doc_id"]].append(r)
    for i, text in corpus():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(found[i], key=lambda r: r["piece"])):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["piece"] == k and r["start"] == at and len(part) == r["length"] <= 256
            assert k == 0 or r["length"] == 256
            assert r["ids_crc32"] == zlib.crc32(b"".join(t.to_bytes(4, "little") for t in part))
            at += r["length"]
        assert at == len(ids)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= 1.06 * -(-total // 256) + 5


def test_chat(spark):
    rows = [
        (1, 0, "user", "a%3C<b>[x]</s>"),
        (1, 1, "assistant", "%25 ok"),
        (1, 2, "user", None),
        (2, 5, "assistant", "later"),
        (2, 1, "system]", "first\n"),
        (2, 7, "assistant", ""),
        (3, 0, "user", "alone"),
        (None, 0, None, "x"),
        (4, None, "assistant", "é"),
        (4, None, "assistant", "é"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in chat.read_back(chat.examples(chat.with_probe(table))).collect()}
    groups = collections.defaultdict(list)
    for c, t, role, text in [*rows, (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(found) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        assert found[c]["n_turns"] == len(turns)
        assert found[c]["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for *_, role, t in turns))
        assert (found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(loss), sha(loss))
    made = chat.examples(table).where("conv_id = 1").orderBy("example").collect()
    assert [(r["example"], r["formatted"][r["mask_start"] : r["mask_start"] + r["mask_chars"]]) for r in made] == [(2, "%2525 ok"), (3, "")]


def toxic_corpus(spark):
    rng, rows, labels = random.Random(9), [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = ["w%s" % rng.choice("abcdefghij") + rng.choice(["an", "el", "or"]) * rng.randint(1, 3) for _ in range(60)]
        if toxic:
            for bad in rng.sample(["moron", "m0r0n", "idiot", "1d10t", "clown", "clooown"], 3):
                words[rng.randrange(60)] = bad
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_corpus(spark)
    found = as_dict(toxicity.score(docs, labels), "held_out", "score", "predicted")
    right = [p == (i % 4 == 0) for i, (h, _, p) in found.items() if h]
    assert len(right) > 80 and sum(right) / len(right) > 0.97
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, (h, _, _) in found.items())
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in found.values())
    kept = toxicity.filter_toxic(docs, labels).count()
    assert 430 <= kept <= 470
    # labels of the held-out fold are not looked at
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert as_dict(toxicity.score(docs, flipped), "predicted") == {i: (p,) for i, (_, _, p) in found.items()}


def test_last_word_of_a_long_spaced_text_decides(spark):
    docs, labels = toxic_corpus(spark)
    clean = [w for r in docs.where("doc_id % 4 = 1").limit(3).collect() for w in r["text"].split()][:50]
    spaced = "  ".join(" ".join(w) for w in clean)
    more = [(10**6 + k, t) for k, t in enumerate([spaced, spaced + "  m o r o n", spaced + "  1 d 1 0 t"])]
    assert all(len(t) > 200 for _, t in more)
    found = as_dict(toxicity.score(docs.union(spark.createDataFrame(more, docs.schema)), labels), "score", "predicted")
    assert [found[i][1:] for i, _ in more] == [(0,), (1,), (1,)]


def test_sample_keeps_the_share_of_labels(spark):
    docs = spark.createDataFrame([(i, "texts that tell nothing") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    for sample in (8000, 30):
        found = as_dict(toxicity.score(docs, labels, sample), "score", "predicted")
        assert all(0.05 < s < 0.2 and p == 0 for s, p in found.values()), sample


def test_lm_scores(docs):
    found = as_dict(pseudolm.score(docs), "n_words", "log_prob", "per_word")
    for i, text in corpus():
        n = len(WORD.findall(text or ""))
        assert found[i][0] == n and (found[i][1] < 0) == (n > 0) and (found[i][2] is None) == (n == 0)


def plain_scores(rows, rounds, shard_words):
    """The whole of operator 3 by loops over (key, id, text), all of whose words have numbers of their own."""
    import numpy as np

    counts = collections.Counter(w for *_, t in rows for w in (t or "").split())
    number = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w.encode())))}
    assert len(number) <= pseudolm.KNOWN
    shards = max(1, math.ceil(sum(counts.values()) / shard_words))

    def windows(text):
        own, edge = [number[w] for w in (text or "").split()], [pseudolm.SIZE] * pseudolm.REACH
        padded = edge + own + edge
        return [([*padded[k : k + len(edge)], *padded[k + 1 + len(edge) : k + 1 + 2 * len(edge)]], n) for k, n in enumerate(own)]

    flat = pseudolm.Network().flat
    for r in range(rounds):
        total = 0
        for shard in range(shards):
            net, own = pseudolm.Network(flat.copy()), [w for key, _, t in sorted(rows) if key % shards == shard for w in windows(t)]
            for a in range(0, len(own), pseudolm.BATCH):
                context, word = (np.array(x) for x in zip(*own[a : a + pseudolm.BATCH]))
                net.learn(context, word, pseudolm.RATE / (r + 1))
            total = total + net.flat.astype(float) * len(own)
        flat = (total / sum(counts.values())).astype(np.float32)
    net = pseudolm.Network(flat)
    return {i: sum(float(net.log_probs(np.array([c]), np.array([w]))[0]) for c, w in windows(t)) for _, i, t in rows}


def test_lm_is_its_restatement_however_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(pseudolm, "SHARD_WORDS", 3000)
    rows = [(i, t) for i, t in corpus(5, 90) if t and "loop" in t or len((t or "").split()) < 400]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r["doc_id"]: r["key"] for r in docs.select("doc_id", F.xxhash64("text", "doc_id").alias("key")).collect()}
    want = plain_scores([(keys[i], i, t) for i, t in rows], pseudolm.ROUNDS, 3000)
    for parts in (1, 5):
        found = as_dict(pseudolm.score(docs.repartition(parts)), "log_prob")
        for i, (p,) in found.items():
            assert p == pytest.approx(want[i], rel=1e-4, abs=1e-3)


def test_training_goes_on_from_the_average(spark):
    text = "red fish blue fish one fish two fish " * 300
    docs = spark.createDataFrame([(k, text) for k in range(8)], "doc_id long, text string").repartition(4)
    found = {}
    for rounds in (1, pseudolm.ROUNDS):
        model, _ = pseudolm.fit(docs, rounds)
        assert model.words == [b"fish", b"blue", b"one", b"red", b"two"] and model.counts.tolist() == [9600, *[2400] * 4]
        found[rounds] = pseudolm.score(docs, model).agg(F.sum("log_prob")).first()[0] / 19200
    assert found[pseudolm.ROUNDS] > found[1] + 0.01


def test_rare_words_have_their_own_probability(spark):
    import numpy as np

    texts = ["one two two three three three", "four four four four two", "", None, "five one  six"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *texts])], "doc_id long, text string")
    counts = collections.Counter(w for t in texts for w in (t or "").split() for _ in range(2))
    table = pseudolm.count_words(docs)
    assert {bytes(r["word"]).decode(): r["n"] for r in table.collect()} == counts
    of = lambda w: int(pseudolm.word_hashes(pa.array([w.encode()], pa.large_binary()))[0] % 1024)
    model = pseudolm.count_model(docs, 1)  # all words but one are looked up by the join
    assert model.words == [b"four"] and model.rest.count() == 5
    net = pseudolm.Network(model.flat)

    def expected(text):
        words, pads, total = (text or "").split(), [pseudolm.SIZE] * 2, 0.0
        own = [0 if w == "four" else pseudolm.KNOWN + of(w) for w in words]
        for k, (n, w) in enumerate(zip(own, words)):
            around = [*(pads + own)[k : k + 2], *(own + pads)[k + 1 : k + 3]]
            total += float(net.log_probs(np.array([around]), np.array([n]))[0])
            if n:
                total += math.log(max(1, counts[w]) / (1 + sum(c for v, c in counts.items() if v != "four" and of(v) == of(w))))
        return total

    for i, (p,) in as_dict(pseudolm.score(docs, model), "log_prob").items():
        assert p == pytest.approx(expected([*texts, *texts][i]), abs=1e-4)
    new = spark.createDataFrame([(1, "one never seen four")], "doc_id long, text string")
    assert pseudolm.score(new, model).collect()[0]["log_prob"] == pytest.approx(expected("one never seen four"), abs=1e-4)


def test_listed_words_of_shared_numbers(monkeypatch):
    import numpy as np

    monkeypatch.setattr(pseudolm, "KNOWN", 1)
    hashes = pseudolm.word_hashes(pa.array([b"a", b"b", b"c"], pa.large_binary()))
    totals = np.arange(10, 10 + pseudolm.OTHERS)
    numbers, more, missing = pseudolm.Vocabulary([b"a", b"b"], np.array([9, 4]), totals)(hashes)
    shared = (hashes % np.uint64(pseudolm.OTHERS)).astype(int)
    assert numbers.tolist() == [0, 1 + shared[1], 1 + shared[2]] and missing.tolist() == [False, False, True]
    assert more == pytest.approx([0.0, math.log(4 / (totals[shared[1]] + 1)), math.log(1 / (totals[shared[2]] + 1))])


def test_quality_filter(docs):
    found = as_dict(quality.quality(docs), "base_failed", "kept")
    kept = {r["doc_id"] for r in quality.filter_quality(docs).collect()}
    assert kept == {i for i, (_, k) in found.items() if k} and all(not k for f, k in found.values() if f)


def operators(labels):
    return {
        "op1": fingerprints.fingerprint_edits,
        "fingerprints": fingerprints.fingerprints,
        "op2": lambda d: bpe.round_trip(d, TIKTOKEN),
        "op3": pseudolm.score,
        "op4": substrings.repeats,
        "op4b": substrings.remove_repeats,
        "op5": lambda d: toxicity.score(d, labels),
        "op6": lambda d: edits.edited_counts(d, TIKTOKEN),
        "op7": jaccard.join_components,
        "op7b": jaccard.keep_one_each,
        "op8": quality.quality,
        "op8b": quality.filter_quality,
        "op10": lambda d: packing.pack_documents(d, JSON),
    }


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (1, 0, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    long = "a very long text " * 4000
    rows = [(None, None), (None, "null id"), (1, long), (1, long), (2, None), (3, ""), (3, "tie"), (4, "tie"), (5, "퟿👍 é")]
    some = spark.createDataFrame([(i, t, None, None, None, 1, 1, 1, 1) for i, t in rows], SCHEMA)
    for name, f in operators(labels).items():
        n = f(some).count()
        assert n <= len(rows) if name in ("op7b", "op8b") else n >= len(rows), name


def test_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], SCHEMA)
    for name, f in operators(labels).items():
        assert f(none).count() == 0, name
    assert chat.read_back(chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "ngram_jaccard", "substring_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] == sizes[4]
    packed = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
