"""Operators on texts against brute force, with nulls, empty and very long texts, repeated rows and extra columns."""

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from listwright.llm import bpe, minhash, packing, substring, suffixes, warc
from listwright.llm.common import written

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, row string, n_chars long"


def words(seed, n, vocabulary=4000):
    draw = np.random.default_rng(seed)
    return " ".join(f"w{x}é" if x % 9 == 0 else f"w{x}" for x in draw.integers(0, vocabulary, n))


def corpus():
    """Rows with shared passages, near copies, periodic text, nulls, empty and repeated rows."""
    shared = words(1, 150)
    long = words(2, 4000)
    texts = [words(10, 200), words(11, 60) + " " + shared + " " + words(12, 50), shared + " " + words(13, 80), words(14, 30) + " " + shared, long, long, long.replace("w7 ", "zz "), "De " * 700, "De " * 900 + "x", "a" * 3000, None, "", " \n\t", "one two", "One TWO", "x" * 399, "word " * 3]
    rows = [(i, t, "en", "clash", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[1], (None, texts[0], None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_suffix(rows, length):
    codes = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(c[p : p + length] for _, c in codes for p in range(len(c) - length + 1))
    out = []
    for doc, c in codes:
        gone = np.zeros(len(c), bool)
        for p in range(len(c) - length + 1):
            if seen[c[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(c), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(c, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [0, 6, suffixes.HOT_ANCHORS])
def test_suffix_array_is_exact(docs, hot):
    """At any number of anchors from which a core isn't gathered: all cores, some, none."""
    assert rows_of(suffixes.suffix_report(docs, hot_anchors=hot)) == brute_suffix(corpus(), 400)


@pytest.mark.parametrize("hot", [3, suffixes.HOT_ANCHORS])
def test_suffix_array_at_boundaries(spark, hot):
    """Passages of just under and over the length, at all offsets from their surroundings."""
    draw = np.random.default_rng(5)
    letters = lambda n: "".join(map(chr, draw.integers(97, 123, n)))
    rows = []
    for size in (399, 400, 401, 463, 520, 900):
        passage = letters(size)
        rows += [(len(rows) + k, letters(draw.integers(0, 700)) + passage + letters(draw.integers(0, 700))) for k in range(4)]
    assert rows_of(suffixes.suffix_report(spark.createDataFrame(rows, "doc_id long, text string"), hot_anchors=hot)) == brute_suffix(rows, 400)


def test_suffix_array_of_a_passage_in_most_documents(spark, monkeypatch):
    """Its ends meet many surroundings; windows are made in many batches."""
    monkeypatch.setattr(suffixes, "BATCH_WINDOWS", 50)
    passage = words(50, 150)
    rows = [(i, f"{words(100 + i, 70)} {passage} {words(300 + i, 70)}" if i % 3 else words(500 + i, 90)) for i in range(60)]
    rows += [(60, passage + " " + passage), (61, words(101, 70)[-150:] + " " + passage), (62, "x" * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(suffixes.suffix_report(df, hot_anchors=20)) == brute_suffix(rows, 400)


def test_files_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    stored = written(docs, "stored")
    before = rows_of(substring.identified(stored, "unused", "number"))
    monkeypatch.setattr(substring, "BROADCAST_FILES", 0)
    assert rows_of(substring.identified(stored, "unused", "number")) == before


def test_suffix_array_of_nothing(empty):
    assert suffixes.suffix_report(empty).count() == 0


def test_loser_tree_merges_with_common_prefixes():
    draw = np.random.default_rng(3)
    runs, every = [], []
    for _ in range(5):
        own = {}
        for _ in range(40):
            key = (bytes(draw.integers(97, 99, draw.integers(1, 12)).tolist()), b"")
            own.setdefault(key, []).append((1, 1))
        every += list(own)
        runs.append(suffixes.Run(dict(zip(suffixes.RUN, suffixes.coded(0, own), strict=True))))
    out = []
    for suffix, shared, run in suffixes.merged(runs):
        out.append((suffix, shared))
        run.taken()
    assert [s for s, _ in out] == sorted(k for k, _ in every)
    for (a, _), (b, shared) in zip(out, out[1:], strict=False):
        assert shared == suffixes.common(a, b)


def test_chunks_are_kept_by_insertions():
    text = words(20, 3000).encode()

    def parts(code):
        at = substring.cuts(np.frombuffer(code, np.uint8)).tolist()
        return [code[a:b] for a, b in zip(at, at[1:], strict=False)]

    before, after = parts(text), parts(text[:5000] + b"inserted" + text[5000:])
    assert b"".join(before) == text
    assert len(set(before) - set(after)) <= 6
    assert max(map(len, before)) <= substring.LONGEST


def test_substring_takes_later_copies(spark):
    shared = words(1, 120)
    rows = [(5, words(2, 100) + " " + shared), (3, shared + " " + words(3, 100)), (9, words(4, 80) + " " + shared + " " + words(5, 80)), (7, words(6, 150)), (8, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")
    got = {r["doc_id"]: r for r in substring.substring_report(df).collect()}
    for doc, text in rows:
        r = got[doc]
        assert r["n_bytes"] == len((text or "").encode())
        if doc in (5, 9):
            assert r["n_spans"] == 1 and r["n_removed"] > len(shared.encode()) - 250
        else:
            assert r["n_removed"] == 0 and r["kept_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def pieces(seed, n, language):
    """Texts of words of a language's length and letters."""
    draw = np.random.default_rng(seed)
    letters, mean = {"en": ("etaoinshrdlu", 4.5), "de": ("enisratdhuläöüß", 6), "fr": ("esaitnruloédpè", 5), "es": ("eaosrnidlctuñá", 5)}[language]
    return " ".join("".join(draw.choice(list(letters), max(1, int(draw.poisson(mean))))) for _ in range(n))


def test_substring_finds_passages_of_51_words(spark):
    rows, long = [], 0
    for k in range(120):
        lang = ("en", "de", "fr", "es")[k % 4]
        passage = pieces(1000 + k, 51, lang)
        for j in range(2):
            rows.append((2 * k + j, pieces(5000 + 2 * k + j, 30, lang) + f" {passage} " + pieces(9000 + 2 * k + j, 25, lang), len(passage.encode())))
    df = spark.createDataFrame(rows, "doc_id long, text string, least long")
    got = {r["doc_id"]: r for r in substring.substring_report(df).collect()}
    for doc, _, n in rows:
        long += doc % 2 and got[doc]["n_removed"] >= n - 8
        assert doc % 2 or got[doc]["n_removed"] == 0
    assert long >= 0.98 * 120


def brute_copies(rows, least):
    """For each text, the bytes of its substrings of `least` bytes or more that also begin earlier, in order of doc_id."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        code, gone = text.encode(), set()
        for i in range(len(code) - least + 1):
            if code[i : i + least] in seen:
                gone |= set(range(i, i + least))
        seen |= {code[i : i + least] for i in range(len(code) - least + 1)}
        out[doc] = gone
    return out


def test_substring_against_brute_force(spark):
    """What is removed also stands earlier, byte for byte; what is left of long copies is little."""
    draw = np.random.default_rng(77)
    stock = [words(100 + i, 90) for i in range(6)]
    rows = []
    for i in range(60):
        parts = [words(1000 + i, int(draw.integers(5, 120)))]
        parts += [stock[j] for j in draw.choice(6, int(draw.integers(0, 3)), replace=False)]
        draw.shuffle(parts)
        rows.append((i, " ".join([*parts, words(3000 + i, 20)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_copies(rows, substring.LEAST)
    out = {r["doc_id"]: r["text"] for r in substring.deduplicated(df).collect()}
    missed = 0
    for doc, text in rows:
        removed = len(text.encode()) - len(out[doc].encode())
        assert removed <= len(want[doc])
        missed += len(want[doc]) - removed
    assert missed <= 0.02 * sum(map(len, want.values()))


def test_substring_keeps_columns_and_characters(docs, empty):
    out = substring.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text is null").count() == 2
    assert out.where("n_chars <> char_length(text)").count() == 0
    assert substring.deduplicated(empty).count() == 0


def brute_groups(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for doc, text, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(lower))
        sets.append((doc, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    label = {d: d for d, _ in sets if d is not None}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if None not in (a, b) and x and y and 100 * len(x & y) >= 75 * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sorted(((d, len(s), label.get(d), d is None or d == label[d]) for d, s in sets), key=repr)


def near_copies():
    base = words(30, 300).split()
    rows = [(100 + i, " ".join(w if (j * 7 + i) % (20 + i) else f"n{i}" for j, w in enumerate(base))) for i in range(25)]
    rows += [(200 + i, words(40 + i, 200)) for i in range(20)] + [(300, rows[3][1].upper()), (20, rows[5][1])]
    passage = words(50, 80)  # a passage that many unlike documents share
    return rows + [(400 + i, words(60 + i, 60) + " " + passage) for i in range(30)]


def test_minhash_groups_are_those_of_brute_force(spark, docs):
    rows = near_copies()
    assert rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_groups(rows)
    assert rows_of(minhash.near_duplicates(docs)) == brute_groups(corpus())


def edited_copies():
    """300 copies of one text with 5 to 7 words replaced: a large group of related texts, median similarity about 0.7."""
    base, draw, rows = words(31, 300).split(), np.random.default_rng(6), []
    for i in range(300):
        own = list(base)
        for j in draw.choice(300, draw.integers(5, 8), replace=False):
            own[j] = f"e{i}x{j}"
        rows.append((i, " ".join(own)))
    return rows


def test_minhash_links_edited_copies_as_brute_force(spark):
    rows = edited_copies()
    want = brute_groups(rows)
    assert 1 < len({r[2] for r in want}) < len(rows)
    assert rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_minhash_exact_pairs_leave_out_no_link(spark):
    unlike = [r for r in near_copies() if r[0] >= 400]  # share a passage only, so they give no pair
    sets = [(i, minhash.Shingler().hashes(t)) for i, t in edited_copies()[:120] + unlike]
    df = written(spark.createDataFrame([(i, s.tobytes()) for i, s in sets], "id long, hashes binary"), "sets")
    got = {tuple(r) for r in minhash.exact_pairs(df.select("id"), df, df.select("id", F.col("id").alias("component"))).collect()}
    both = [(a, b, len(np.intersect1d(x, y)), len(np.union1d(x, y))) for a, x in sets for b, y in sets if a < b]
    want = {(a, b) for a, b, n, m in both if 100 * n >= 75 * m}
    assert want and want <= got and all(b < 400 for _, b in got)


def test_minhash_of_nothing(empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "x long, y long")
    assert {tuple(r) for r in minhash.components(links).collect()} == {(i, 0) for i in range(41)}


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack_documents(docs, path).collect()
    encoder = Tokenizer.from_file(path)
    want = Counter()
    for doc, text, *_ in corpus():
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[doc, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in out) == want
    by_bin = {}
    for r in out:
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_bin.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("text", ["Hello, world's end... It's 3x-4", "ΣΑΣ ΟΔΟΣ", "a\x1cb c\x1f", "<|endoftext|> x", "İstanbul ǅ", "é́ ﬁ", "don't WON'T", " x y\u0085z", "x" * 5000, "日本語 テキスト", "🙂🙂 a"])
def test_packing_tokenizes_as_the_library(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    words_ = packing.Words(path)
    own = words_.parts(text)
    words_.learn(set(own))
    encoder = Tokenizer.from_file(path)
    assert np.frombuffer(b"".join(words_.known[w] for w in own), "<u4").tolist() == encoder.encode(text, add_special_tokens=False).ids


ADDED = ["ab <|endoftext|> cd", "ab<|endoftext|>cd", "x <|ENDOFTEXT|> y<|EndOfText|>", "ΟΔΟΣ<|endoftext|>ΣΑΣ", "a\x1c<|startoftext|>b", "<|endoftext|><|startoftext|>", "ab  <|endoftext|>\n cd", "<|endoftext|", "don<|startoftext|>'t", "e<|endoftext|>\u0301"]


def test_packing_keeps_added_tokens(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = Tokenizer.from_file(path)
    rows = list(enumerate(ADDED))
    want = []
    for i, text in rows:
        ids = encoder.encode(text, add_special_tokens=False).ids + [1]
        want.append((i, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = packing.tokenized_pieces(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    assert sorted(tuple(r)[:5] for r in got) == want


def test_sums_are_indexed_and_checked_against_counts():
    draw = np.random.default_rng(6)
    for _ in range(200):
        counts = np.zeros(61, np.int64)
        for x in draw.integers(1, 60, int(draw.integers(1, 8))):
            counts[x] += 1
        sums = packing.Sums(counts)
        has = np.repeat(np.arange(61), counts).tolist()
        free = counts.copy()
        for x in draw.choice(has, len(has) // 3, replace=False):  # some are used up
            free[x] -= 1
        left = np.repeat(np.arange(61), free).tolist()
        made = {sum(c) for n in (1, 2, 3) for c in itertools.combinations(left, n)}
        for gap in range(1, 61):
            got = sums.exact(gap, free)
            assert (got is not None) == (gap in made)
            assert got is None or sum(got) == gap and not Counter(got) - Counter(left)


def test_packing_plan_places_all_and_wastes_little():
    draw = np.random.default_rng(1)
    counts = Counter(np.minimum(draw.lognormal(5.5, 1.3, 20000).astype(int) + 1, 4096).tolist())
    plan = packing.packing_plan(counts)
    placed, filled = Counter(), Counter()
    for length, _, copies, times, first, _ in plan.tolist():
        placed[length] += copies * times
        for b in range(first, first + times):
            filled[b] += copies * length
    assert placed == counts and max(filled.values()) <= 4096
    assert len(filled) <= -(-sum(k * v for k, v in counts.items()) // 4096) + 1


def test_bpe_as_the_library(docs, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc, text, *_ in corpus():
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    for space_led in (False, True):
        assert rows_of(bpe.encoded(docs, path, public_tokenizers.PATTERN, space_led=space_led)) == sorted(want, key=repr)
    assert bpe.encoded(empty, path, public_tokenizers.PATTERN).count() == 0
    full = bpe.encoded(docs.where("doc_id = 1"), path, public_tokenizers.PATTERN, with_ids=True).first()
    assert full["ids"] == library.encode_ordinary(corpus()[1][1]) and full["decoded"] == corpus()[1][1]


def test_bpe_words_of_any_length_and_odd_spaces():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = bpe.Words(path, public_tokenizers.PATTERN, True)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    draw = np.random.default_rng(2)
    long = ["".join(draw.choice(list("abeinsthé"), n)) for n in (1, 2, 30, 401, 1500)] + ["a" * 1999, "ab" * 700, "日本語" * 200]
    own.learn_words(set(long))
    for word in long:
        assert np.frombuffer(own.known[word], "<u4").tolist() == library.encode_ordinary(word)
    parts = ["a", "Word", " ", "  ", "\n", "\t", "\u00a0", "'s", "don't", "42", "!?", "é", "日本", "\u2003", "\x1f", "🙂", "\r\n", " b", "c "]
    texts = ["".join(draw.choice(parts, int(draw.integers(1, 12)))) for _ in range(3000)]
    cut = [own.divided(x) for x in texts]
    own.learn(set().union(*cut))
    codes = [b"".join(own.known[p] for p in x) for x in cut]
    assert [np.frombuffer(c, "<u4").tolist() for c in codes] == [library.encode_ordinary(x) for x in texts]
    assert own.decoded(codes) == [x.encode() for x in texts]
    assert any(len(x) > 1 for x in cut)
    # decoding begins at the ids: a damaged one changes the text
    assert own.decoded([codes[0][:-4] + np.array([own.ranks[b"zz"]], "<u4").tobytes()]) != [texts[0].encode()]


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", "é" * 1000, None, "", "<p>a</p>"]
    rows = [(i, f"http://x.example/{i}\r\nX: y", h, "extra") for i, h in enumerate(html)] + [(None, None, "<p>b</p>", None), (5, "http://again", "<p>a</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    records, payloads = warc.write_archive(pages)
    got = warc.read_archive(records, payloads).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    top = {}
    for i, _, h, _ in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h, _ in rows:
        code = (h or "").encode()
        response = i is None or i == top[h or ""]
        want.append((i, len(code), base64.b32encode(hashlib.sha1(code).digest()).decode(), "response" if response else "revisit", None if response else top[h or ""]))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert payloads.count() == 4
    assert warc.with_payloads(records, payloads).count() == len(rows)


def test_warc_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archive(*warc.write_archive(pages)).count() == 0


def test_parse_warc(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(record * 3)
    rows = warc.parse_warc(spark, str(tmp_path / "x.warc")).collect()
    assert [bytes(r["block"]) for r in rows] == [b"hello"] * 3


def test_written_survives_in_the_shared_folder(spark):
    assert written(spark.range(5), "x").count() == 5
    assert written(spark.range(5).where(F.col("id") > 9), "x").count() == 0


def odd_strings(n):
    """Letters that lower-case to more than letters, marks, characters of other versions of Unicode, and punctuation."""
    draw = np.random.default_rng(5)
    several = [chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000 and (not chr(c).lower().isalpha() or len(chr(c).lower()) > 1) and chr(c).isalnum()]
    newer = [chr(c) for c, _ in bpe.unlike_characters()] or ["x"]
    parts = ["\u0130", "\u01c5", "\u00df", "e\u0301", "\u0307", "H", "caf\u00e9", "'s", "'S", "...", "!", ">", "<|", "|>", " ", "\n", "  ", "1", "\u0663", "\u03c2", "\u03a3", "\u65e5", "\u0338", "\x1c", "\x85", "\xa0", "\u200b", "-", "'"]
    return ["".join(str(draw.choice(k)) for k in ((parts, parts, parts, several, newer)[i] for i in draw.integers(0, 5, int(draw.integers(1, 9))))) for _ in range(n)]


def test_odd_strings_as_the_tokenizers():
    import tiktoken
    from tokenizers import Tokenizer

    strings = odd_strings(20_000) + ["\u0130...", "H\u0130!", "caf\u00e9\u0130, x", "\u0130|>", "\U0001258d's"]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    own = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bytewise = bpe.Words(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, True, bpe.unlike_characters())
    for low in range(0, len(strings), 500):
        some = strings[low : low + 500]
        for make, divide, expected in ((own, own.parts, lambda x: whole.encode(x, add_special_tokens=False).ids), (bytewise, bytewise.divided, library.encode_ordinary)):
            parts = [divide(x) for x in some]
            make.learn(set().union(*parts))
            for x, p in zip(some, parts, strict=True):
                assert np.frombuffer(b"".join(make.known[w] for w in p), "<u4").tolist() == expected(x), ascii(x)
