"""Parts that need no session: each against a plain version."""

import itertools
import random

import numpy as np
import pytest

from lodestat.llm import chat, hamming, html, lines, lm, packing, simhash, tokens, toxicity

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_boundaries_cost_least():
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randint(1, 7)
        lengths = np.array(sorted(rng.sample(range(1, 40), n)))
        counts = np.array([rng.randint(1, 9) for _ in range(n)])
        for buckets in (1, 2, 3, 9):
            cost = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))
            least = min(cost([*own, lengths[-1]]) for k in range(min(buckets, n)) for own in itertools.combinations(lengths[:-1], k))
            got = packing.boundaries(lengths, counts, buckets)
            assert len(got) <= buckets and got[-1] == lengths[-1] and cost(got) == least
    assert packing.boundaries(np.array([], int), np.array([], int), 3) == []


def test_encoder_is_exact_on_odd_texts():
    rng = random.Random(2)
    plain = tokenizers.Tokenizer.from_file(BPE)
    signs = ["a", "B", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "é", "ß", "日本", "12", "...", "a.", "a,b", "Ab's", "'t", "don't", "ª.", "É!", "x²", "_", "\x1c", "\x85", "\xa0", " ", " ", "​", "😀", "<|endoftext|>", "́", "\0"]
    texts = ["", None, " ", "x" * 3000, *["".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(3000)]]
    enc = tokens.Encoder(BPE)
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, f"<u{enc.width}").tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    h = tokens.PerfectHash.build(keys)
    assert sorted(h.slot(keys).tolist()) == list(range(len(keys)))


def test_index_finds_keys_and_rejects_others():
    keys = np.sort(np.random.default_rng(5).integers(0, 10**6, 5000))
    index = tokens.Index(tokens.index_bytes(keys, np.arange(5004), 3, 4))
    own, first, count = np.unique(keys, return_index=True, return_counts=True)
    got_first, got_count = index.find(own, keys)
    assert (got_first == first + 3).all() and (got_count == count).all() and index.nulls == 3
    assert not index.find(np.arange(2_000_000, 2_200_000), keys)[1].any()


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(20)] + [base]))
    rng.shuffle(codes)
    q, c = hamming.GrayIndex(codes).within(codes, 3)
    near = np.bitwise_count(codes[:, None] ^ codes) <= 3
    assert {*zip(q.tolist(), c.tolist(), strict=True)} == {*zip(*[x.tolist() for x in np.nonzero(near)], strict=True)} and len(q) == near.sum()


def test_pairs_stay_in_their_group():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 64, 500).astype(np.uint64)
    gid = np.sort(rng.choice([1, 1, 1, 2, 3, *range(4, 60)], 500))
    got = [(i, j) for a, b in hamming.pairs_within(gid, codes, 2) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    want = [(i, j) for i in range(500) for j in range(i + 1, 500) if gid[i] == gid[j] and int(codes[i] ^ codes[j]).bit_count() <= 2]
    assert sorted(got) == want


def test_fingerprint_against_plain_version():
    xxhash = pytest.importorskip("xxhash")

    def plain(text):
        words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
        if not words:
            return 0
        runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
        h = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for text in ("", " \t", "One", "one TWO", "É é\x0bÄ a\xa0b c", "a b c d e f a b c d " * 50):
        assert simhash.fingerprint(text) == plain(text), text
    assert simhash.fingerprint(None) == 0


def test_edit_distance_against_table():
    rng = random.Random(6)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(2000):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in "ab")
        most = rng.randint(0, 12)
        assert min(lines.edit_distance(a, b, most), most + 1) == min(plain(a, b), most + 1), (a, b)


def test_simhashes_against_plain_version():
    rng = np.random.default_rng(12)
    size = np.array([5, 1, 254, 255, 256, 511, 2000, 7, *rng.integers(1, 300, 300)])
    h = rng.integers(0, 2**64, size.sum(), dtype=np.uint64)
    at = 0
    for n, got in zip(size.tolist(), lines.simhashes(h, size).tolist(), strict=True):
        own = [int(x) for x in h[at : at + n]]
        at += n
        assert got == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > n)


def test_lines_are_normalised():
    assert lines.normal_lines("A-b, C1!\n\nÉ") == [b"a b c1", b"", "é".encode()]
    assert [lines.normal_line(x) for x in "A-b, C1!\n\nÉ".split("\n")] == lines.normal_lines("A-b, C1!\n\nÉ")


def test_distance_bound_is_from_above():
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choices("abcdef ", k=rng.randint(50, 400)))
        b = list(a)
        for _ in range(rng.randint(0, 40)):
            b[rng.randrange(len(b))] = rng.choice(["", "x", "ab"])
        b = "".join(b)
        most = rng.randint(0, 80)
        assert min(lines.distance_bound(a, b, most), most + 1) >= min(lines.edit_distance(a, b, 10**6), most + 1)
        assert lines.similar(a, b) == (lines.edit_distance(a, b, 10**6) <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_chat_escapes_are_reversible_and_leave_no_control_string():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choices([*chat.CONTROLS, "\\", "-", "\\-", "<", "|", ">", "s", "[", "/INST]", "é"], k=rng.randint(0, 8)))
        got = chat.escape(text)
        assert chat.unescape(got) == text and not any(c in got for c in chat.CONTROLS)


def test_prefix_code_is_prefix_free():
    counts = np.random.default_rng(8).integers(0, 100, 256)
    length, _, bit = lm.prefix_code(counts)
    words = {tuple(bit[k, : length[k]]) for k in range(256)}
    assert len(words) == 256 and abs(sum(2.0 ** -length) - 1) < 1e-12


def test_model_probabilities_of_next_bytes_sum_to_one():
    """At one place of a word all codes of a byte together have probability 1, whatever the counts."""
    words = [b"aba", b"abb", b"b", b"abcde", b"abcdf", b""]
    code = lm.prefix_code(np.bincount(np.frombuffer(b"".join(words) + b" \n", np.uint8), minlength=256))
    state, c = np.array([0, 1, 1, 0, 0, 1]), np.array([3, 2, 5, 1, 0, 4], np.float32)
    bits = lm.Bits(words, state, code)
    n, n1 = bits.beginnings(bits.order(), np.zeros(6, np.int64), c)
    for k in range(len(bits.bit)):
        row = bits.word[k]
        own = "".join(map(str, bits.bit[bits.begin[row] : k]))
        alike = [r for r in range(6) if "".join(map(str, bits.bit[bits.begin[r] : bits.begin[r] + bits.size[r]])).startswith(own)]
        assert n[k] == c[alike].sum()
        assert n1[k] == sum(c[r] for r in alike if bits.bit[bits.begin[r] + k - bits.begin[row]] == 1)


def test_main_text_of_a_page():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>Home</a></nav>
    <div class="cookie-notice">We use cookies.</div><article><h1>Big &amp; small</h1><p>First <b>part</b>, which is
    long enough.<p>Second&nbsp;part.<ul><li>one<li>two</ul><div class=ad>Buy!</div><script>if (a<b) x("</p>")</script>
    <section id="comments"><p>Nice article, dear author.</p></section></article><aside>More</aside><form><input>Name</form>
    <footer>&copy; me</footer></body></html>"""
    assert html.main_text(page) == "Big & small\nFirst part, which is long enough.\nSecond part.\none\ntwo"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("just text &lt;b&gt;") == "just text <b>"
    bare = "<body><div id=menu><a href=1>a</a><a href=2>b</a></div><div><p>" + "</p><p>".join(["A sentence, with signs. And more of it."] * 5) + "</p><p>Short.</p></div><div><a href=3>c</a></div></body>"
    assert html.main_text(bare) == "\n".join(["A sentence, with signs. And more of it."] * 5 + ["Short."])
    assert html.main_text("<p>" * 3000 + "deep" + "<div>" * 2000) == "deep"


def test_grammar_scopes_and_targets():
    lexicon = toxicity.Lexicon({"lowei*": 4.0, "zorb": 3.0})
    weight = lambda text: toxicity.clause_weight(lexicon.symbol(w) for w in text.lower().split())
    assert weight("a nice day") == 0
    assert weight("you idiot") > weight("an idiot") > 0
    assert weight("not an idiot") < weight("an idiot") and weight("he said idiot") < weight("he saw idiot")
    assert weight("kill the light") == 0 < weight("I kill you")
    assert weight("loweisch da") == 4.0 and weight("zorb!!") == 3.0
    assert toxicity.features(None, lexicon) == toxicity.features("", lexicon) == (0.0, 0.0, 0.0)


def test_bits_of_words_are_held_in_few_bytes():
    """Counts of beginnings are 32-bit numbers unless they are very large, and the same either way."""
    words = [b"ab", b"abc", b"b", b""]
    code = lm.prefix_code(np.bincount(np.frombuffer(b"".join(words) + b" \n", np.uint8), minlength=256))
    bits = lm.Bits(words, np.zeros(4, np.int64), code)
    assert bits.node.dtype == np.uint8 and code[1].max() <= 255
    few, many = (bits.beginnings(bits.order(), np.zeros(4, np.int64), np.array([3.0, 2.0, 1.0, 4.0]) * f) for f in (1, 2.0**32))
    assert few[0].dtype == np.uint32 and many[0].dtype == np.float64
    for a, b in zip(few, many, strict=True):
        assert (a * 2.0**32 == b).all()
