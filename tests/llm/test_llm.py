"""The training-data operators against plain versions, with odd rows: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import itertools
import math
import random
import re
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripweave.llm import ann, bpe, chat, gif, licenses, neardup, packing, quality, sharding, toxicity

DOCS = "doc_id long, text string, score int"
ODD = [(1, None, 0), (2, "", 0), (3, "mit license " * 2000, 0), (4, "a b c", 1), (4, "a b c", 1), (None, "x y z", 2), (6, "Ünïcode 五   text", 3), (7, "a b c", 4)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def plain_jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


def test_jump_hash(spark, odd):
    keys = [0, 1, 2, 10**6, -5, 2**63 - 1, *range(3, 200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 8, 9, 1000):
        assert [r[0] for r in df.select(sharding.jump_hash(F.col("k"), n)).collect()] == [plain_jump(k, n) for k in keys]
    rows = sharding.assign_shards(odd, 3).collect()
    assert len(rows) == len(ODD)
    for s in range(3):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    assert sharding.assign_shards(odd.limit(0), 3).count() == 0


def test_chat_round_trip(spark):
    nasty = ["</turn>", "<turn:user>", "\\", "\\l", "\\s\\g", "a<", "</tu", "", None, "</turn>\n<turn:a>b", "\\### Assistant: </turn> ok", "plain"]
    turns = [(c, t, r, x) for c in (1, 2) for t, (r, x) in enumerate(zip(["user", "assistant", None, "a>b", "sys<", "assistant"] * 2, nasty))] + [(3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (3, None, "user", "first"), (None, 1, "user", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got[1] == got[2] == [(r or "", x or "") for c, t, r, x in turns if c == 1]
    assert got[3] == [("user", "first"), ("assistant", "x"), ("assistant", "x")] and got[None] == [("user", "y")]
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_licenses_odd_rows(odd):
    rows = [r for r in licenses.license_report(odd).collect()]
    assert len(rows) == len(ODD)
    long = next(r for r in rows if r.doc_id == 3)
    assert (long.n_words, long.n_base, long.first_word, long.last_word, long.labels) == (4000, 2000, 0, 3998, "mit")
    assert next(r for r in rows if r.doc_id == 1).labels == ""


def wordings(regex):
    """A text for each alternative of a rule's regex, without what is optional."""
    from re import _constants as C
    from re import _parser

    def one(op, arg):
        if op is C.LITERAL:
            return [chr(arg)]
        if op is C.NOT_LITERAL:
            return ["x"]
        if op is C.IN:
            return [chr(arg[0][1] if arg[0][0] is C.LITERAL else arg[0][1][0])]
        if op is C.BRANCH:
            return [s for branch in arg[1] for s in every(branch)]
        if op is C.SUBPATTERN:
            return every(arg[-1])
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            return ["".join(p) for p in itertools.product(every(arg[2]), repeat=arg[0])]
        assert op is C.ASSERT
        return [""]

    def every(parsed):
        return ["".join(p) for p in itertools.product(*(one(*x) for x in parsed))]

    return every(_parser.parse(regex))


def test_license_rules_pass_gate_and_keyword(spark):
    gates = licenses.gates()
    for _, _, _, keywords, regex in licenses.rules():
        for text in wordings(regex):
            assert re.search(regex, f" {text} ") and any(k in text for k in keywords.split("|")) and any(g in text for g in gates), text
    texts = {
        "This code is released under the GPL v3.": "gpl", "LGPL": "lgpl", "See AGPL": "agpl", "WTFPL": "wtfpl", "3-Clause BSD": "bsd-3", "FreeBSD": "bsd-2", "0BSD": "bsd-0",
        "This program is free software; you can redistribute it and/or modify": "gpl", "This library is free software; you can redistribute it and/or modify": "lgpl",
        "Neither the name of X nor the names of its contributors may be used to endorse": "bsd-3", "All advertising materials mentioning features or use of this software must display": "bsd-4",
        "I waive all copyright": "public-domain", "a b c": "",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.license_report(docs).collect()}
    assert got == dict(enumerate(texts.values()))


def plain_scan(text):
    """Words, base places and unsuppressed detections of a text, by their definitions."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    base = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    joined = " " + " ".join(words) + " "
    found = []
    for rule, priority, label, _, regex in licenses.rules():
        for m in re.finditer(regex, joined):
            first = joined[: m.start()].count(" ") - 1
            found.append((first, first + len(m.group().split()), priority, rule, label))
    found.sort(key=lambda m: (m[0], -m[1], m[2], m[3]))
    kept = [m for k, m in enumerate(found) if not any(f[0] <= m[0] and f[1] >= m[1] and f[2] <= m[2] for f in found[:k])]
    return words, base, kept


def license_texts():
    rnd = random.Random(21)
    samples = [t for _, _, _, _, regex in licenses.rules() for t in wordings(regex)[:2]]
    plain = ["the", "a", "code", "of", "New", "version", "2", "mit license", "Apache License", "general public license", "mit", "license", "licence", "GNU", "\n", "—", "日本", "e-mail"]
    texts = [" ".join(rnd.choice(samples if rnd.random() < 0.3 else plain) for _ in range(rnd.choice([1, 3, 8, 30]))) for _ in range(150)]
    return [*texts, None, "", " ", "mit LICENSE mit License", "mit license " * 3000, *samples[:40]]


def test_licenses_match_a_plain_scan(spark):
    texts = license_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for k, text in enumerate(texts):
        if text and len(text) > 20_000:
            continue
        words, base, kept = plain_scan(text)
        r = found[k]
        assert r.n_words == len(words) and r.n_base == len(base) and sorted(r.base) == sorted({b for _, b in base})
        assert (r.first_word, r.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert [tuple(d) for d in r.detections] == kept, text
    long = found[texts.index("mit license " * 3000)]
    assert (long.n_base, len(long.detections)) == (3000, 3000)


def test_scans_of_empty_tables(spark):
    none, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for rows in (
        licenses.license_report(none), gif.media_report(none), bpe.token_report(none, "word_bpe_49k.json"), toxicity.toxicity_report(none, labels), quality.quality_report(none, labels), toxicity.keep_clean(none, labels),
        quality.keep_good(none, labels), neardup.keep_one(none), packing.sequences(none, packing.pack_documents(none)), sharding.assign_shards(none),
    ):
        assert rows.count() == 0


def test_gif_formats():
    rnd = np.random.default_rng(1)
    for k in range(60):
        bits, n = int(rnd.integers(2, 9)), int(rnd.integers(0, 9000))
        data = (rnd.integers(0, 1 << bits, n) if k % 2 else np.sort(rnd.integers(0, 1 << bits, n))).astype(np.uint8).tobytes()
        assert gif.lzw_unpack(gif.lzw_pack(data, bits), bits, n + 1) == data
    palette = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)
    own = palette[::-1].copy()
    square = np.array([[0, 1], [2, 3]], np.uint8)
    frames = [gif.Frame(0, 0, 4, 4, np.ones((4, 4), np.uint8), palette, 5, 1), gif.Frame(1, 1, 2, 2, square, palette, 7, 2, 0), gif.Frame(0, 0, 2, 2, square, own, 3, 3), gif.Frame(0, 0, 1, 1, np.array([[2]], np.uint8), palette, 1, 0)]
    width, height, read = gif.read_gif(gif.write_gif(4, 4, palette, frames))
    assert (width, height) == (4, 4) and [(f.delay, f.disposal, f.transparent) for f in read] == [(5, 1, None), (7, 2, 0), (3, 3, None), (1, 0, None)]
    assert all((a.indices == b.indices).all() for a, b in zip(frames, read))
    canvases = [c.copy() for c in gif.shown(width, height, read)]
    assert tuple(canvases[1][1, 1]) == (255, 0, 0, 255)  # seen through the transparent number
    assert tuple(canvases[2][1, 1]) == (0, 0, 0, 255) and tuple(canvases[2][2, 2]) == (0, 0, 0, 0)  # cleared by disposal 2, then drawn over
    assert tuple(canvases[3][0, 0]) == (0, 255, 0, 255) and tuple(canvases[3][1, 1]) == (0, 0, 0, 0)  # back to before by disposal 3
    assert gif.colour_histogram(canvases[0]).sum() == 16
    lines = np.arange(8)[:, None] * np.ones((1, 3), int)
    stored = np.concatenate([lines[0::8], lines[4::8], lines[2::4], lines[1::2]])
    assert (gif._interlaced(stored) == lines).all()
    for broken in (b"", b"GIF89a", gif.write_gif(4, 4, palette, frames)[:-20]):
        with pytest.raises((ValueError, IndexError, struct.error)):
            gif.read_gif(broken)


def test_gif_rows(odd):
    rows = {(r.doc_id, r.n_bytes): r for r in gif.media_report(odd).collect()}
    for i, t, _ in ODD:
        wanted = gif.expected_report(i, t)
        got = rows[i, wanted["n_bytes"]]
        assert all(got[k] == v for k, v in wanted.items())


def test_bpe_matches_the_library(spark, odd):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.tokenizer(path)
    library.no_truncation()
    library.no_padding()
    rnd = random.Random(4)
    long = "".join(rnd.choice("aeinrst") for _ in range(9000)) + "ab" * 3000
    texts = ["", long, "It's DON'T we'll ''s", "ΣΑΣ İ é", "a<|endoftext|>b", "½ ² 五十 😀 \x85 \x00", "x" * 900, *("".join(rnd.choice("aeinrst") for _ in range(700)) for _ in range(20))]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids
        assert own.decode(own.encode(t)) == library.decode(ids, skip_special_tokens=False)
    assert own.decode(own.encode("grüße welt"), as_text=True) == "grüße welt "
    assert 0 < own.transducer.most_pending < own.merges.lookahead + bpe.WINDOW + own.merges.longest
    rows = bpe.token_report(odd, "word_bpe_49k.json").collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}


def test_tokens_leave_by_the_lookahead_alone():
    """Random merge lists over few symbols, and chains in which a far symbol decides: what leaves early is what the definition gives for the whole word."""
    rnd = random.Random(17)
    lists = [[("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f")][::-1], [("x", "x"), ("xx", "x"), ("xx", "xx")]]
    for _ in range(150):
        tokens, merges = list("abcd"), []
        for _ in range(rnd.randint(1, 25)):
            pair = (rnd.choice(tokens), rnd.choice(tokens))
            if len("".join(pair)) <= 6 and pair not in merges and "".join(pair) not in tokens:
                merges.append(pair)
                tokens.append("".join(pair))
        lists.append(merges)
    for merges in lists:
        symbols = sorted(set("abcdefx") if merges in lists[:2] else set("abcd"))
        vocab = {t: k for k, t in enumerate(dict.fromkeys([*symbols, *(a + b for a, b in merges)]))}
        own = bpe.Merges(vocab, merges, "")
        machine = bpe.Transducer(own)
        for _ in range(12):
            word = "".join(rnd.choice(symbols) for _ in range(rnd.randint(1, 200)))
            assert machine.word(word) == b"".join(vocab[t].to_bytes(4, "little") for t in own.plain(word)[0]), (merges, word)
        assert machine.most_pending <= own.lookahead + bpe.WINDOW + own.longest
    chain = bpe.Merges({t: k for k, t in enumerate([*"abcdef", "ab", "bc", "cd", "de", "ef"])}, lists[0], "")
    assert chain.lookahead == 5 and chain.plain("abcdef")[0] == ["ab", "cd", "ef"] and chain.plain("abcde")[0] == ["a", "bc", "de"]


def test_packing(spark, odd):
    rnd = random.Random(7)
    sizes = [rnd.randint(1, 64) for _ in range(700)]
    bins, places, opened, final = packing.pack_sizes(sizes, (16, 32, 64))
    for b in set(bins.tolist()):
        at = sorted((places[k], sizes[k]) for k in np.flatnonzero(bins == b))
        assert all(p + s == q for (p, s), (q, _) in zip(at, at[1:])) and at[0][0] == 0
        total = sum(s for _, s in at)
        assert total <= final[bins == b][0] and final[bins == b][0] == min(c for c in (16, 32, 64) if c >= total) <= opened[bins == b][0]
    used = sum(final[bins == b][0] for b in set(bins.tolist()))
    assert sum(sizes) / used > 0.93
    packed = packing.pack_documents(odd, lengths=(8, 16))
    rows = packed.collect()
    assert sum(r.n_tokens for r in rows) == sum(len(re.findall(r"\S+", t or "", re.ASCII)) + 1 for _, t, _ in ODD)
    check_sequences(packing.sequences(odd, packed).collect(), [(i, [*re.findall(r"\S+", t or "", re.ASCII), packing.END]) for i, t, _ in ODD], 16)
    assert packing.pack_documents(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack_sizes([0])


def check_sequences(bins, docs, longest):
    """Every document's tokens are in the bins once, whole, piece by piece."""
    pieces = []
    for b in bins:
        ends = [*b.starts[1:], b.n_tokens]
        assert len(b.tokens) == b.n_tokens <= b.bin_length and b.starts[0] == 0
        pieces += [(i, tuple(b.tokens[at:end])) for i, at, end in zip(b.doc_ids, b.starts, ends)]
    wanted = [(i, tuple(t[k : k + longest])) for i, t in docs for k in range(0, len(t), longest)]
    assert sorted(pieces, key=repr) == sorted(wanted, key=repr)


def test_packing_in_blocks_leaves_no_block_half_empty(spark):
    """Blocks of a few rows, whose under-filled bins are packed again together; the layout of the input does not matter."""
    rnd = random.Random(3)
    docs = [(k, " ".join(["w"] * rnd.randint(0, 70))) for k in range(600)] + [(7, "same text")] * 50 + [(8, "one"), (8, "two"), (8, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    packed = packing.pack_documents(df, lengths=(16, 32, 64), block_rows=40)
    bins = packing.sequences(df, packed).collect()
    check_sequences(bins, [(i, [*(t or "").split(), packing.END]) for i, t in docs], 64)
    whole = packing.pack_documents(df, lengths=(16, 32, 64)).select("bin_id", "bin_length").distinct().agg(F.sum("bin_length")).first()[0]
    assert sum(b.bin_length for b in bins) <= 1.04 * whole
    turned = packing.pack_documents(df.orderBy(F.desc("text")).repartition(7), lengths=(16, 32, 64), block_rows=40)
    assert sorted(map(tuple, turned.collect()), key=repr) == sorted(map(tuple, packed.collect()), key=repr)


def test_packing_of_token_ids(spark):
    pytest.importorskip("public_tokenizers")
    texts = {k: " ".join(f"word{j}" for j in range(k * 7 % 50)) for k in range(40)}
    ids = bpe.encode_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "word_bpe_49k.json")
    own = bpe.tokenizer(bpe.vocabulary_path("word_bpe_49k.json"))
    docs = ids.withColumn("text", F.hex("ids"))
    tokens = F.array_append(F.transform(F.regexp_extract_all("text", F.lit("[0-9A-F]{8}"), F.lit(0)), lambda x: F.conv(x, 16, 10)), F.lit("end"))
    bins = packing.sequences(docs, packing.pack_documents(docs, size=F.size(tokens)), tokens).collect()
    wanted = [(k, [*(str(int(x.hex(), 16)) for x in (own.encode(t)[j : j + 4] for j in range(0, len(own.encode(t)), 4))), "end"]) for k, t in texts.items()]
    check_sequences(bins, wanted, packing.LENGTHS[-1])


def least_price(sizes, lengths):
    """The cheapest way to pack, over all ways to part the sizes."""

    def ways(rest, bins):
        if not rest:
            yield sum(packing.price(min(c for c in lengths if c >= b)) for b in bins)
            return
        for k in range(len(bins)):
            if bins[k] + rest[0] <= lengths[-1]:
                yield from ways(rest[1:], [*bins[:k], bins[k] + rest[0], *bins[k + 1 :]])
        yield from ways(rest[1:], [*bins, rest[0]])

    return min(ways(sizes, []))


def test_packing_is_near_the_optimum():
    rnd, ratios = random.Random(5), []
    for _ in range(60):
        sizes = [rnd.randint(1, 2000) for _ in range(7)]
        bins, _, _, final = packing.pack_sizes(sizes, (512, 1024, 2048))
        ratios.append(sum(packing.price(int(final[bins == b][0])) for b in set(bins.tolist())) / least_price(sizes, (512, 1024, 2048)))
    assert np.mean(ratios) < 1.08 and max(ratios) < 1.4 and min(ratios) >= 1 - 1e-12


def brute(texts, size):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies():
    rnd = random.Random(11)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = {}
    for base in range(12):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 8, 40, 120]))]
        for _ in range(8):
            copy = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 12))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts[len(texts)] = " ".join(copy)
    return texts


def test_estimate_loses_less_than_bands():
    """Of pairs at the threshold, the estimate drops fewer than miss all bands."""
    n = neardup.REGISTERS
    found, filled = neardup.estimate(np.zeros((n + 1, n), np.uint16), (np.arange(n) >= np.arange(n + 1)[:, None]).astype(np.uint16))
    least = int(np.flatnonzero(found >= neardup._cut(neardup.Rule(), filled))[0])
    lost = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(least))
    assert lost < (1 - 0.8**neardup.ROWS) ** neardup.BANDS


def crowd():
    """One base text and 150 copies with words of their own in it, of which many are just above or below the threshold from each other."""
    rnd = random.Random(12)
    words = [f"w{k}" for k in range(60)]
    texts = {}
    for k in range(150):
        copy = list(words)
        for at in rnd.sample(range(60), rnd.randint(0, 6)):
            copy[at] = f"x{rnd.randrange(3 if k % 3 else 10_000)}"
        texts[k] = " ".join(copy)
    return texts


@pytest.mark.parametrize("chunk", [1 << 12, 1 << 14, 8 << 20])
def test_near_duplicates_in_crowded_groups(spark, monkeypatch, chunk):
    """Groups are dealt into chunks of a few members; every key with more than two rows counts as hot."""
    monkeypatch.setattr(neardup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(neardup, "HOT_KEYS", 1 << 40)
    monkeypatch.setattr(neardup, "LEAST_HOT", 2)
    texts = near_copies()
    texts |= {len(texts) + k: t for k, t in crowd().items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, neardup.Rule(2)).collect()}
    assert got == brute(texts, 2)


def test_forest_is_short_and_whole():
    sets = [neardup.shingle_set(t, 2) for t in crowd().values()]
    sketches = np.array([neardup.registers(x, neardup.level(len(x))) for x in sets])
    pairs = neardup.forest(np.arange(len(sets)), np.arange(len(sets)), sketches, sets, neardup.Rule(2))
    groups = {}
    for k, (_, c) in brute(crowd(), 2).items():
        groups.setdefault(c, set()).add(k)
    assert len(pairs) == sum(len(g) - 1 for g in groups.values())


def test_near_duplicates_match_brute_force(spark, odd):
    texts = near_copies()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for size in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, neardup.Rule(size)).collect()}
        assert got == brute(texts, size)
    rows = neardup.near_duplicates(odd, neardup.Rule(2)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in rows) == [(-1, 2, -1, True), (1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (4, 2, 4, True), (4, 2, 4, True), (6, 3, 6, True), (7, 2, 4, False)]
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_nearest(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 8))
    x[7] = x[5] = x[20]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] + [1.0] * 7), (1003, [1.0]), (20, x[20].tolist())]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    got = {q: [r for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in range(0, 400, 20)}
    hits = []
    for q, rs in got.items():
        s = x @ x[q]
        order = [k for k in np.lexsort((np.arange(400), -s)) if k != q][:20]
        assert [r["rank"] for r in rs] == list(range(1, 21)) and np.allclose([r.score for r in rs], s[[r.vec_id for r in rs]])
        hits.append(len({r.vec_id for r in rs} & set(order)) / 20)
    assert np.mean(hits) >= 0.9
    own = [r.vec_id for r in got[20]]
    assert {5, 7} <= set(own) and own.index(5) < own.index(7)
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01/embeddings.parquet").exists(), reason="the given tables are elsewhere")
def test_recall_on_the_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    table = rows.toPandas()
    x, ids = np.array(table["embedding"].tolist(), np.float64), table["vec_id"].to_numpy()
    hits = []
    found = ann.nearest(rows, F.col("vec_id") % 20 == 0).toPandas()
    for q, own in found.groupby("query_id"):
        s = x @ x[ids == q][0]
        order = [ids[k] for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        assert np.allclose(own["score"], [s[ids == i][0] for i in own["vec_id"]], rtol=1e-12, atol=0)
        hits.append(len(set(own["vec_id"]) & set(order)) / 20)
    assert len(hits) == (ids % 20 == 0).sum() and np.mean(hits) >= 0.9


def test_nearest_from_sparse_cells(spark):
    """Two hot clusters, and five vectors whose halves are one of each: their cell holds fewer than a result."""
    rnd = np.random.default_rng(5)
    a, b = np.eye(8)[0] + np.eye(8)[4], np.eye(8)[1] + np.eye(8)[5]
    x = np.concatenate([np.tile(a, (500, 1)), np.tile(b, (500, 1)), np.tile(np.concatenate([a[:4], b[4:]]), (5, 1))]) + rnd.normal(size=(1005, 8)) * 0.02
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.nearest(rows, F.col("vec_id") >= 1000).collect()
    for q in range(1000, 1005):
        got = {r.vec_id for r in found if r.query_id == q}
        order = [k for k in np.argsort(-(x @ x[q])) if k != q][:20]
        assert len(got) == 20 and len(got & set(order)) >= 18


def test_block_max_search_is_exact():
    rnd = np.random.default_rng(1)
    vectors = []
    for _ in range(500):
        t = np.sort(rnd.choice(80, rnd.integers(0, 12), replace=False))
        w = rnd.random(len(t))
        vectors.append((t, w / np.sqrt((w * w).sum()) if len(t) else w))
    vectors[5] = vectors[400] = vectors[17]
    index, dense = toxicity.Index(vectors, 80), np.zeros((500, 80))
    for k, (t, w) in enumerate(vectors):
        dense[k, t] = w
    for k in range(100):
        t, w = vectors[k]
        if len(t):
            s = dense @ dense[k]
            s[k] = 0
            order = [i for i in np.lexsort((np.arange(500), -s.round(12)))[:15] if s[i] > 0]
            assert index.nearest([(t, w), (t, w)], 15, [k, k])[1][0].tolist() == order


def corpus(n=600):
    rnd = random.Random(8)
    words = [f"{a}{b}" for a in ("lor", "ip", "dol", "sit", "am") for b in ("em", "sum", "or", "et", "ed", "ul")]
    docs, labels = [], []
    for k in range(n):
        lines = [" ".join(rnd.choice(words) for _ in range(12)).capitalize() + "." for _ in range(4)]
        bad, toxic = k % 5 == 0, k % 7 == 0
        if bad:
            lines[1:] = [" ".join(w.upper() + "!!" for w in x.split()) for x in lines[1:]]
        if toxic:
            lines[0] += " you " + rnd.choice(["grufolix", "brandolin", "smerkat"])
        docs.append((k, "\n".join(lines)))
        labels.append((k, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_letters_of_all_scripts_are_no_symbols():
    lines = ["これは日本語の文です", "這是一個句子", "한국어 문장", "ＡＢＣ ａｂｃ", "𐐀𐐁 𐐨𐐩", "plain words", "☃ 😀"]
    x = quality._own(lines)
    assert x[:, 3].tolist() == [0, 0, 0, 0, 0, 0, 1]
    assert x[3:5, 1].tolist() == [0.5, 0.5]


def test_forward_backward_against_enumeration():
    rnd = np.random.default_rng(2)
    field = quality.Field(rnd.normal(size=3), rnd.normal(size=(2, 2)))
    counts = np.array([1, 4, 3])
    x = rnd.normal(size=(8, 3))
    p, _ = quality.marginals(field, x, counts)
    at = 0
    for n in counts:
        total, good = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(y[k] * (x[at + k] @ field.weights) for k in range(n)) + sum(field.pairs[y[k], y[k + 1]] for k in range(n - 1)))
            total, good = total + w, good + w * np.array(y)
        assert np.allclose(p[at : at + n], good / total)
        at += n


def test_quality_and_toxicity_held_out(spark, labelled, odd):
    docs, labels = labelled
    q = quality.quality_report(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(q) > 100 and (q.predicted == q.quality).mean() > 0.97 and q.score.between(0, 1).all()
    t = toxicity.toxicity_report(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (t.predicted == t.toxic).mean() > 0.97 and t.score.between(0, 1).all()
    field, model = quality.fit(docs, labels), toxicity.fit(docs, labels)
    scored = toxicity.score_documents(quality.score_documents(odd, field), model)
    assert scored.count() == len(ODD) and scored.filter("quality_score IS NULL OR toxicity IS NULL").count() == 0
    none = labels.limit(0)
    assert [(r.score, r.predicted) for r in quality.quality_report(docs.limit(3), none).collect()] == [(0.5, 0)] * 3
    assert {r.predicted for r in toxicity.toxicity_report(docs.limit(3), none).collect()} == {0}
    clashing = docs.limit(50).withColumns({c: F.col("doc_id") for c in ("toxicity", "evidence", "quality", "quality_score", "_body")})
    for kept in (toxicity.keep_clean(clashing, labels), quality.keep_good(clashing, labels)):
        assert kept.columns == clashing.columns and all(r.toxicity == r.quality == r.evidence == r.doc_id for r in kept.collect())


def test_documents_with_any_common_term_have_neighbours(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    scored = toxicity.score_documents(docs, model)
    assert scored.filter(F.size("evidence") == 0).count() == 0
    dense = np.zeros((model.index.n, len(model.terms)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k, i in enumerate(model.ids.tolist()):
        t, w = model.vector(*model.terms.counts(texts[i]))
        dense[k, t] = w
    for r in scored.limit(40).collect():
        t, w = model.vector(*model.terms.counts(r.text))
        s = dense[:, t] @ w
        order = np.lexsort((np.arange(len(s)), -s.round(12)))[:3]
        assert [e.doc_id for e in r.evidence] == model.ids[order].tolist() and np.allclose([e.cosine for e in r.evidence], s[order])


def test_pipeline_stages(spark, labelled, tmp_path):
    import corpus_pipeline

    docs, labels = labelled
    more = docs.unionByName(docs.filter("doc_id % 50 = 3").withColumn("doc_id", F.col("doc_id") + 10_000)).withColumn("lang", F.lit("en"))
    more.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == more.columns
        counts.append({r.doc_id for r in now.select("doc_id").collect()})
    good = {k for k in range(600) if k % 5}
    assert len(good - counts[0]) <= 6 and not {k for k in counts[0] if k < 600} - good
    assert not {k for k in counts[1] if k < 600 and k % 7 == 0}
    assert not {k for k in counts[2] if k >= 10_000}
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert {i for r in packed.select("doc_ids").collect() for i in r.doc_ids} == counts[2]
