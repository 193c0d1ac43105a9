"""Operators that work on single texts, against plain re-statements."""

import base64
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from cladeflow.llm import bpe, edits, fingerprints, packing, pretokens, pseudolm, quality, toxicity
from cladeflow.llm.textops import Words, as_column, buffer

WORD = re.compile(r"[^\x20\x09-\x0d]+")
TEXTS = [
    "",
    " \n\t ",
    "a",
    "the cat sat on the mat and the cat sat on the mat again",
    "x\n\nx\n y \n y \nx",
    "it's 'squad' ''s he'll  we've\n\n'tis\t 'd x'",
    "é'stu ǅ ²³Ⅷ 日本 　 x\xa0 y\x85z \x1c w 👍🏽 naïve's",
    "spam " * 60,
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "%%% ### | $1 & <b>",
]


def random_texts(n, alphabet, most=60, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


MORE = TEXTS + random_texts(400, "a bs't\n 1.lre'vé　m d")


def column(texts):
    return as_column(pa.array(texts, pa.string()))


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(ranks), special_tokens={})


def test_words():
    words = Words(*buffer(column(MORE)))
    data = words.data.tobytes()
    for i, text in enumerate(MORE):
        own = range(words.first[i], words.first[i + 1])
        assert [data[words.starts[k] : words.ends[k]].decode() for k in own] == WORD.findall(text)
    assert len(Words(*buffer(column([]))).starts) == 0


def test_split_is_the_pattern():
    pieces = pretokens.Pieces(MORE)
    for i, text in enumerate(MORE):
        own = [pieces.text(k) for k in range(pieces.first[i], pieces.first[i + 1])]
        assert own == regex.findall(public_tokenizers.PATTERN, text)


def test_transducer_is_the_library(ranks, library):
    both = bpe.codec(ranks)
    ids, first = both.encode(MORE)
    for i, text in enumerate(MORE):
        own = ids[first[i] : first[i + 1]].tolist()
        assert own == library.encode_ordinary(text)
        assert both.decode(own, step=3) == text
    rng = random.Random(2)
    for _ in range(2000):
        data = bytes(rng.randrange(256) for _ in range(rng.randint(1, 9)))
        assert both.transducer.encode(data) == library._encode_single_piece(data)


def test_transducer_forgets(ranks, library):
    small = bpe.Transducer(bpe.parse_ranks(ranks), max_states=20)
    for text in random_texts(300, "etaoinshrdlu", 20):
        assert small.encode(text.encode()) == (library.encode_ordinary(text) if text else [])


def test_decoder_waits_for_whole_characters():
    decoder = bpe.Utf8Decoder([bytes([i]) for i in range(256)])
    data = "aé日👍".encode()
    assert "".join([*(decoder.feed([b]) for b in data), decoder.close()]) == "aé日👍"
    decoder = bpe.Utf8Decoder([bytes([i]) for i in range(256)])
    assert decoder.feed([0xE6, 0x97]) == "" and decoder.close() == "�"


def test_decoder_is_the_one_of_python():
    rng = random.Random(6)
    tokens = [bytes(rng.choice([rng.randrange(256), 0x61, 0x80, 0xBF, 0xE0, 0xED, 0xF0, 0xF4]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    tokens += [c.encode() for c in "aé日👍\ud7ff\U0010ffff"]
    automaton = bpe.Utf8Decoder(tokens)
    for _ in range(800):
        ids = [rng.randrange(len(tokens)) for _ in range(rng.randint(0, 12))]
        decoder, data = bpe.Utf8Decoder(tokens, automaton), b"".join(tokens[i] for i in ids)
        found = []
        for k in range(0, len(ids), 2):
            found.append(decoder.feed(ids[k : k + 2]))
            assert len(decoder.state) <= 3
        assert "".join([*found, decoder.close()]) == data.decode("utf-8", "replace")


def test_cache_survives_conflicts_and_emptying():
    cache = pretokens.PreTokenCache(lambda texts: [[ord(c) for c in t] for t in texts], bits=3, pool=50)
    for _ in range(3):
        for text in MORE[:80]:
            ids, first = cache.ids(pretokens.Pieces([text, text]))
            assert ids.tolist() == [ord(c) for c in text * 2] and first.tolist() == [0, len(text), 2 * len(text)]


def brute_repeats(words):
    n, out = len(words), []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_suffix_arrays():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)] + TEXTS
    found = quality.measures(column(texts), min_repeat=3)
    for i, text in enumerate(texts):
        words = WORD.findall(text)
        repeats = brute_repeats(words)
        mark = lambda least, length: len({p for k, r in enumerate(repeats) if r >= least for p in range(k, k + length(r))})
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = {
            "n_words": len(words),
            "word_chars": sum(map(len, words)),
            "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": mark(5, lambda r: 5),
            "longest_repeat": max(repeats, default=0),
            "covered_words": mark(3, lambda r: r),
        }
        assert {k: int(found[k][i]) for k in want} == want, text


def test_syncmers():
    def brute(text):
        from cladeflow.llm.textops import Hasher, mix

        k, s = fingerprints.K, fingerprints.S
        if len(text) < k:
            return [0] if text else []
        inner = Hasher(mix(np.array([ord(c) for c in text], np.uint64) + np.uint64(1))).windows(s).tolist()
        at = []
        for p in range(len(text) - k + 1):
            window = inner[p : p + k - s + 1]
            if min(window) in (window[0], window[-1]):
                at.append(p)
        return at

    texts = MORE[:80] + ["lorem ipsum dolor sit amet " * 9]
    anchors = fingerprints.Anchors.of(texts)
    for i, text in enumerate(texts):
        assert anchors.positions[anchors.first[i] : anchors.first[i + 1]].tolist() == brute(text)
    gaps = np.diff(anchors.positions)[np.diff(anchors.rows) == 0]
    assert 0 < gaps.min() and gaps.max() <= fingerprints.K - fingerprints.S
    assert anchors.packed[1:, 0][np.diff(anchors.rows) == 0].tolist() == gaps.tolist()
    assert fingerprints.Anchors.of([texts[3]]).strings()[0] == anchors.strings()[3]
    changed = [fingerprints.edited(a, b) for a, b in zip(texts, texts[1:])]
    kept = [len(a) - len(a) // 3 for a in texts[:-1]]
    assert anchors.spliced(kept, changed).strings() == fingerprints.Anchors.of(changed).strings()


def test_edits_follow(ranks, library):
    counter, rng, alphabet = edits.counter(ranks), random.Random(3), "ab  'sltre\n\n1.é"
    for n in [0, 1, 5, 60, 400, 1500] * 25:
        text = "".join(rng.choice(alphabet) for _ in range(n))
        tree = next(iter(counter.trees([text])))
        for _ in range(5):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 3, 30]))
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 9, 200])))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text and tree.total == len(library.encode_ordinary(text))
    tree = edits.TokenTree.of("word " * 5000, counter.one)
    tree.edit(12_000, 12_003, "x")
    assert tree.reencoded < 100
    with pytest.raises(ValueError):
        tree.edit(5, 3, "")


def test_edits_touch_a_path_of_the_tree(library):
    count = lambda t: len(library.encode_ordinary(t))
    rng, text = random.Random(5), "some words of a text, " * 4000
    tree = edits.TokenTree.of(text, count)
    many = tree.root.leaves

    def check(node, depth=0):
        """All sums, fan-out and depth; gives the leaves' depths."""
        if isinstance(node, edits.Block):
            assert (node.chars, node.tokens) == (len(node.text), sum(node.counts)) and sum(node.lengths) == node.chars
            assert len(node.lengths) <= 2 * edits.BLOCK
            return {depth}
        assert len(node.below) <= edits.FAN
        assert (node.chars, node.tokens) == (sum(c.chars for c in node.below), sum(c.tokens for c in node.below))
        assert node.leaves == sum(c.leaves for c in node.below)
        return set().union(*(check(c, depth + 1) for c in node.below))

    for k in range(400):
        a = rng.randint(0, len(text))
        b = min(len(text), a + rng.choice([0, 0, 0, 4, 30, 3000 if k % 40 == 0 else 1]))
        new = rng.choice(["", "one ", " inserted words,", "x " * rng.randint(1, 400 if k % 25 == 0 else 5)])
        before, rebuilt = {id(x) for x in tree.blocks}, tree.rebuilt
        tree.edit(a, b, new)
        text = text[:a] + new + text[b:]
        replaced = tree.rebuilt - rebuilt
        assert replaced <= 4 + (b - a) // 20 and len(before - {id(x) for x in tree.blocks}) <= replaced
        assert len(check(tree.root)) <= 1
    assert tree.text == text and tree.total == count(text) and many > 500
    again = edits.TokenTree(*tree.state(), count)
    assert again.total == tree.total and again.text == text
    tree.edit(0, len(text), "")
    assert tree.total == 0 and tree.text == ""
    tree.edit(0, 0, "new text")
    assert tree.total == count("new text")


def test_deobfuscation():
    words = "idiot moron clown stupid loser scum trash worthless pathetic disgusting hello world the and".split()
    model = toxicity.CharModel(toxicity.trigram_counts([" ".join(words)] * 50))
    for seen, meant in [
        ("1d10t", "idiot"),
        ("m0r0n", "moron"),
        ("$tup1d", "stupid"),
        ("stuuuupid", "stupid"),
        ("m.o.r.o.n", "moron"),
        ("i d i o t", "idiot"),
        ("p@thet1c", "pathetic"),
        ("hello", "hello"),
    ]:
        assert model.decode(seen) == meant
    found = toxicity.Features(column(["you 1d10t, m o r o n, and $cum! erer*** the%%% WORDS!!"]), model, {})
    assert set(found.restored) >= {"idiot", "scum", "moron"} and not any("words" in r for r in found.restored)
    assert len(toxicity.Features(column(["", " "]), model, {}).keys) == 0


def test_spelled_out_phrases():
    words = "you are a an and the of or idiot moron clown stupid loser hello world".split()
    rng = random.Random(4)
    model = toxicity.CharModel(toxicity.trigram_counts([" ".join(rng.choice(words) for _ in range(2000))]))
    for text, meant in [
        ("y o u i d i o t", "idiot"),
        ("a m o r o n", "moron"),
        ("y o u a r e a n i d i o t a n d a m o r o n", "moron"),
        ("y  o  u  a  r  e    a    m  o  r  o  n", "moron"),
        ("the-m-o-r-o-n-and", "moron"),
        ("a.n.d." * 40 + "m.o.r.o.n", "moron"),
        ("m\no\nr\to\nn", "moron"),
        ("s" * 100 + "tup1d", "stupid"),
    ]:
        found = toxicity.Features(column([text]), model, {})
        plain = toxicity.Features(column([meant]), None)
        assert meant in found.restored and set(plain.keys) <= set(found.keys), text
    # probabilities of words agree with sums over every choice of borders
    letters, gaps = "youidiot", {2: 1, 3: 2, 5: 1}
    total = collections.Counter()
    for bits in range(8):
        cuts = [g for k, g in enumerate(gaps) if bits >> k & 1]
        costs = [((toxicity.SKIP, toxicity.BORDER) if kind == 1 else (toxicity.NARROW, toxicity.SKIP))[g in cuts] for g, kind in gaps.items()]
        score = sum(costs)
        parts = [letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)])]
        for part in parts:
            s = [0, 0, *(toxicity.SYMBOL[c] for c in part), 0]
            score += sum(float(model.log[s[k], s[k + 1], s[k + 2]]) for k in range(len(s) - 2))
        for part in [*parts, None]:
            total[part] += np.exp(score)
    likely = {p for p, x in total.items() if p and x / total[None] >= toxicity.LIKELY}
    assert set(model._likely(letters, gaps)) == likely and len(likely) < len(total) - 1


def test_weighted_fit_is_that_of_all_rows():
    rng = np.random.default_rng(6)
    y = (np.arange(9000) % 9 == 0).astype(float)
    x = rng.normal(0, 1, (9000, 2)) + y[:, None]
    every = toxicity.fit_logistic(x, y)
    some = np.concatenate([np.flatnonzero(y == 1), np.flatnonzero(y == 0)[:1000]])
    weighted = toxicity.fit_logistic(x[some], y[some], weight=np.where(y[some] == 1, 1.0, 8.0))
    assert np.abs(weighted - every).max() < 0.3 < 1.5 < toxicity.fit_logistic(x[some], y[some])[0] - every[0]


def test_viterbi_is_the_best_of_all_readings():
    rng = random.Random(11)
    words = "idiot moron bad dog a an it".split()
    model = toxicity.CharModel(toxicity.trigram_counts([" ".join(rng.choice(words) for _ in range(500))]))

    def readings(runs, narrow):
        """Every (text, cost of the channel) of what was seen."""
        if not runs:
            return [("", 0.0)]
        (c, n), rest = runs[0], readings(runs[1:], narrow)
        if c in toxicity.SYMBOL:
            own = [(c * n, 0.0)] if n < 3 else [(c, toxicity.SHORTEN), (c * 2, toxicity.SHORTEN)]
        elif c == " ":
            own = [("", toxicity.NARROW), (" ", toxicity.SKIP)] if n > narrow else [("", toxicity.SKIP), (" ", toxicity.BORDER)]
        else:
            own = [(x * m, toxicity.SUBSTITUTE * n) for x in toxicity.LOOKS_LIKE.get(c, "") for m in {1, min(n, 2)}] + [(c * n, 0.0)]
        return [(a + b, x + y) for a, x in own for b, y in rest]

    def score(text):
        total = 0.0
        for word in text.split(" "):
            s = [0, 0, *(toxicity.SYMBOL.get(c, 1) for c in word), 0]
            total += sum(float(model.log[s[k], s[k + 1], s[k + 2]]) for k in range(len(s) - 2)) - 3.0 * s.count(1)
        return total

    for _ in range(300):
        seen = "".join(rng.choice(["i", "d", "1", "0", "t", ".", "ooo", "@", "b", "--"]) for _ in range(rng.randint(1, 7))).strip(".-")
        if not seen:
            continue
        runs = [(" " if c in ".-" else c, len(list(g))) for c, g in itertools.groupby(seen, lambda c: " " if c in ".-" else c)]
        narrow = min((n for c, n in runs if c == " "), default=0)
        best = max(score(t) + c for t, c in readings(runs, narrow))
        found = model.decode(seen)
        assert max(score(t) + c for t, c in readings(runs, narrow) if t == found) == pytest.approx(best, abs=1e-3)


def test_trigrams_count_borders():
    counts = toxicity.trigram_counts(["ab", " b", ""]).reshape((toxicity.SIZE,) * 3)
    a, b = toxicity.SYMBOL["a"], toxicity.SYMBOL["b"]
    assert counts[0, 0, a] == 1 and counts[0, 0, b] == 1 and counts[0, a, b] == 1 and counts[a, b, 0] == 1


def numbers_of(words, texts):
    """Numbers and contexts of the texts' words, by plain loops."""
    index = {w: k for k, w in enumerate(words)}
    numbers, around = [], []
    for text in texts:
        own = [index[w] for w in text.split()]
        padded = [pseudolm.SIZE] * pseudolm.REACH + own + [pseudolm.SIZE] * pseudolm.REACH
        for k in range(len(own)):
            window = padded[k : k + 2 * pseudolm.REACH + 1]
            around.append(window[: pseudolm.REACH] + window[pseudolm.REACH + 1 :])
        numbers += own
    return np.array(around), np.array(numbers)


def test_network_learns_and_is_a_distribution():
    rng = np.random.default_rng(0)
    net = pseudolm.Network()
    context = rng.integers(0, pseudolm.SIZE + 1, (1, 2 * pseudolm.REACH))
    every = np.arange(pseudolm.SIZE)
    total = np.exp(net.log_probs(np.repeat(context, len(every), 0), every)).sum()
    assert total == pytest.approx(1, abs=1e-4)
    words, texts = ["fish", "red", "blue", "one", "two"], ["red fish blue fish one fish two fish " * 40] * 8
    vocabulary = pseudolm.Vocabulary([w.encode() for w in words], np.arange(9, 4, -1), np.zeros(pseudolm.OTHERS))
    found = Words(*buffer(column(texts)))
    word, more, missing = vocabulary(found.hashes())
    context = pseudolm.contexts(word, found.rows)
    assert all(np.array_equal(x, y) for x, y in zip((context, word), numbers_of(words, texts)))
    assert not more.any() and not missing.any()
    before = net.log_probs(context, word).mean()
    for _ in range(60):
        net.learn(context, word, 0.1)
    assert net.log_probs(context, word).mean() > before + 3


def test_log_probability_restated():
    net = pseudolm.Network(seed=4)
    for part in net.parts.values():
        part += np.random.default_rng(part.size).normal(0, 0.3, part.shape)
    p = {k: v.astype(float) for k, v in net.parts.items()}
    for context, word in (([1, 2, 3, 4], 77), ([5, 4096, 7, 4096], 4000), ([0, 0, 0, 0], 0)):
        x = np.concatenate([p["embed"][c] for c in context])
        h = np.tanh(p["inner"].T @ x + p["inner_bias"])
        a, b, c = word // 256, word // 16 % 16, word % 16
        logits = (h @ p["outer"]).reshape(3, 16) + [p["first_bias"], p["second_bias"][a], p["third_bias"][16 * a + b]]
        want = sum(logits[k, d] - np.log(np.exp(logits[k]).sum()) for k, d in enumerate((a, b, c)))
        assert net.log_probs(np.array([context]), np.array([word]))[0] == pytest.approx(want, abs=1e-4)


def test_gradient():
    net, rng = pseudolm.Network(), np.random.default_rng(1)
    net.flat[:] = net.flat + rng.normal(0, 0.1, len(net.flat)).astype(np.float32)
    context, word = np.array([[1, 2, 3, 4], [5, 6, 7, 4096]]), np.array([77, 4000])
    flat = net.flat.copy()
    net.learn(context, word, 0.0)
    slopes = net.slopes.copy()
    assert np.array_equal(net.flat, flat)
    places = [*rng.choice(np.flatnonzero(slopes), 25, replace=False), *rng.choice(np.flatnonzero(slopes == 0), 3)]
    for at in places:
        h = 1e-2
        up, down = flat.copy(), flat.copy()
        up[at] += h
        down[at] -= h
        numeric = -(pseudolm.Network(up).log_probs(context, word).mean() - pseudolm.Network(down).log_probs(context, word).mean()) / (2 * h)
        assert slopes[at] == pytest.approx(numeric, abs=2e-3)


def test_training_steps_do_not_depend_on_how_rows_arrive():
    rng = np.random.default_rng(2)
    n = 20 * pseudolm.BATCH + 77
    context, word = rng.integers(0, pseudolm.SIZE, (n, 2 * pseudolm.REACH)), rng.integers(0, pseudolm.SIZE, n)
    whole = pseudolm.Trainer(pseudolm.Network().flat, 0.1)
    whole.add(context, word)
    parts = pseudolm.Trainer(pseudolm.Network().flat, 0.1)
    for a in range(0, n, 9999):
        parts.add(context[a : a + 9999], word[a : a + 9999])
    (x, seen), (y, also) = whole.done(), parts.done()
    assert seen == also == n and np.array_equal(x, y)


def test_vocabulary_file_by_rank():
    content = packing.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.encode_special_tokens = True
    encoder = packing.Encoder(content)
    assert encoder.cache is not None
    texts = MORE + ["<|endoftext|> x"]
    ids, first = encoder(texts)
    for i, e in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[first[i] : first[i + 1]].tolist() == e.ids
    encoder.cache, encoder.tokenizer = None, tokenizer
    assert encoder(texts)[0].tolist() == ids.tolist()


def test_added_tokens_are_those_of_the_library():
    content = packing.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_str(content.decode()), packing.encoder(content)
    assert encoder.cache is not None
    for texts in (MORE, [*MORE, "<|endoftext|> x", "a<|endoftext|><|endoftext|>", "<|endoftext|", "", "b  <|endoftext|>  c"]):
        ids, first = encoder(texts)
        assert len(first) == len(texts) + 1
        for i, e in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert ids[first[i] : first[i + 1]].tolist() == e.ids
    assert encoder(["<|endoftext|> x"])[0].tolist() == [50256, 2124]


def test_cuts():
    assert packing.cut_points(1, 8) == [(0, 1)]
    assert packing.cut_points(8, 8) == [(0, 8)]
    assert packing.cut_points(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_genetic_packing():
    rng = random.Random(1)
    for _ in range(20):
        sizes = [rng.randint(1, 99) for _ in range(rng.randint(1, 200))]
        best = packing.evolve(sizes, 100, [], rng.randint(0, 99))[0]
        assert sorted(i for b in best.bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in best.bins)
        assert len(best.bins) <= len(packing.best_fit(sizes, 100, 0.0, rng).bins)
        again = packing.unlabel(sizes, 100, packing.labels(best))
        assert len(again.bins) == len(best.bins)
    a, b = packing.best_fit(sizes, 100, 0.3, rng), packing.best_fit(sizes, 100, 0.3, rng)
    child = packing.crossover(a, b, rng)
    assert sorted(i for b in child.bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in child.bins)


def test_evolution_beats_best_fit_where_that_wastes_room():
    rng = random.Random(5)
    plain = evolved = 0
    for seed in range(6):
        sizes = [rng.randint(400, 1000) for _ in range(600)]
        plain += len(packing.best_fit(sizes, 2048, 0.0, rng).bins)
        evolved += len(packing.evolve(sizes, 2048, [], seed)[0].bins)
    assert evolved < 0.985 * plain
    # an optimum is met: pairs that fill a bin exactly, hidden among others
    sizes = [x for _ in range(40) for a in [rng.randint(700, 1023)] for x in (a, 2048 - a)]
    assert len(packing.evolve(sizes, 2048, [], 1)[0].bins) == 40


def test_ranks_file(ranks):
    parsed = bpe.parse_ranks(ranks)
    line = ranks.splitlines()[300].split()
    assert parsed[base64.b64decode(line[0])] == int(line[1])
    assert hashlib.sha256(ranks).hexdigest() and collections.Counter(map(len, parsed))[1] == 256
