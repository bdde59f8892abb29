"""BPE as a streaming transducer: tokens leave as soon as no later character can change them.

Two neighbouring tokens of a BPE result never depend on what stands around them: a token list is the result for its text just
if every neighbouring pair is the result for its own text. So for each prefix of a word the last token is the one suffix that
goes with the last token of what is left, and it never changes. Later symbols can change which prefixes' tokens the result is made of, but
not further back than the merge list's sufficient lookahead (``lookahead``, after Berglund and van der Merwe, 2023): a border that lies that
far behind what is read is settled, and the tokens before it leave. So no more than the lookahead, a window and a token are ever pending.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER = 1 << 60
#: The last symbol of a word carries the end mark; it is held as one character in a plane of its own.
END_PLANE = 0xF0000
#: Symbols between two looks at what is final; words and pairs remembered.
WINDOW, WORDS, PAIRS = 16, 200_000, 250_000
#: Words begin alike: what is held after so many symbols is remembered. All are less than any lookahead and window.
BEGINNINGS, BEGUN = (8, 6, 4), 100_000
#: Longer texts are read in stretches of so many characters, or STEP words at a time.
LONG, STEP = 65_536, 4096
#: Patterns of public files whose words never hold or depend on white space: a text may be cut at spaces and line feeds first.
SPACED = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in out)
    out |= {b: chr(256 + k) for k, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class Merges:
    """A merge list over symbols; the end mark is folded into a word's last symbol."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix = suffix
        self.ids = {self.fold(t): i for t, i in vocab.items()}
        self.parts: dict[str, tuple[str, str]] = {}
        self.rank: dict[tuple[str, str], int] = {}
        self.born: dict[str, int] = {}
        folded = [(self.fold(a), self.fold(b)) for a, b in merges]
        for r, pair in enumerate(folded):
            self.rank.setdefault(pair, r)
        for token in dict.fromkeys(a + b for a, b in folded):
            out, last = self.plain(token)
            if len(out) == 1:  # else BPE never makes it, even from its own text
                self.parts[token], self.born[token] = last, self.rank[last]
                if any(self.born.get(x, -1) >= self.rank[last] for x in last):
                    raise ValueError("a merge list whose parts are not made before they are merged")
        self.tokens = {t for t in self.ids if len(t) == 1} | set(self.born)
        self.begins = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.ends = {t[k:]: False for t in self.tokens for k in range(1, len(t))} | dict.fromkeys(self.tokens, True)
        self.longest = max(map(len, self.tokens))
        self.spines: dict[tuple[str, int], list[tuple[str, int, int]]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def fold(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(END_PLANE + ord(body[-1]))
        return token

    def spine(self, token: str, side: int) -> list[tuple[str, int, int]]:
        """The pieces at one end of a token while it is built: each with the ranks at which it is made and used up."""
        found = self.spines.get((token, side))
        if found is None:
            found, piece, end = [], token, NEVER
            while True:
                made = self.born.get(piece, -1)
                found.append((piece, made, end))
                if made < 0:
                    break
                piece, end = self.parts[piece][side], made
            self.spines[token, side] = found
        return found

    def stable(self, a: str, b: str) -> bool:
        """True if BPE of the two tokens' joined text is these two tokens: no merge ever reaches over their border."""
        found = self.pairs.get((a, b))
        if found is None:
            found, rank = True, self.rank.get
            for x, x_made, x_end in self.spine(a, 1):
                for y, y_made, y_end in self.spine(b, 0):
                    r = rank((x, y))
                    # Of equal merges the leftmost comes first: that inside a goes before the one at the border, that before the one inside b.
                    if r is not None and r < x_end and r <= y_end and x_made < y_end and y_made < x_end:
                        found = False
                        break
                if not found:
                    break
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = found
        return found

    @cached_property
    def lookahead(self) -> int:
        """Symbols that suffice beyond a border to settle it. A merge over the border can be kept from happening only by a merge of lower rank that takes away what stands at
        the right end of its right part, which in turn only one of still lower rank can prevent: the longest such chain, in symbols. Of equal merges the leftmost
        comes first, so they never depend on what is to their right."""
        best: dict[str, int] = {}
        most = 1
        for (a, b), _ in sorted(self.rank.items(), key=lambda x: x[1]):
            reach = len(b) + max((best.get(piece, 0) for piece, _, _ in self.spine(b, 1)), default=0)
            best[a] = max(best.get(a, 0), reach)
            most = max(most, reach)
        return most

    def plain(self, symbols: str) -> tuple[list[str], tuple[str, str] | None]:
        """BPE by its definition, always the leftmost merge of the lowest rank; with the last merge made."""
        out, made, rank = list(symbols), None, self.rank.get
        while len(out) > 1:
            r, k = min([(rank(p, NEVER), k) for k, p in enumerate(zip(out, out[1:]))])
            if r == NEVER:
                break
            made = (out[k], out[k + 1])
            out[k : k + 2] = [out[k] + out[k + 1]]
        return out, made


class Transducer:
    """Symbols in, token ids out (as bytes, four a token). Held are the last token that left, the symbols pending after it, and the last
    token of each prefix of these. Whenever ``WINDOW`` more symbols are pending than the lookahead, what is settled leaves."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.code = {t: i.to_bytes(4, "little") for t, i in merges.ids.items()}
        self.lookahead = merges.lookahead
        self.begun: dict[str, tuple[list[int], list[str | None]]] = {}  # what is held after these first symbols
        self.most_pending = 0  # symbols that were ever pending at once

    def _settled(self, at: int, starts: list[int]) -> int:
        """The last border of what is read that lies the lookahead behind."""
        end = at
        while end > 0 and end > at - self.lookahead:
            end = starts[end]
        return max(end, 0)

    def _leave(self, end: int, starts: list[int], tokens: list[str | None]) -> list[str]:
        out = []
        while end:
            out.append(tokens[end])
            end = starts[end]
        return out[::-1]

    def word(self, symbols: str) -> bytes:
        ends, stable, pairs = self.merges.ends.get, self.merges.stable, self.merges.pairs
        longest, code = self.merges.longest, self.code
        out: list[bytes] = []
        base, mark, first, starts, tokens = 0, self.lookahead + WINDOW, 0, [-1], [""]
        for n in BEGINNINGS:
            known = self.begun.get(symbols[:n]) if n < len(symbols) else None
            if known:
                first, starts, tokens = n, known[0].copy(), known[1].copy()
                break
        for end in range(first + 1, len(symbols) + 1):
            at = end - base
            tries = []
            for start in range(at - 1, max(-1, at - 1 - longest), -1):
                piece = symbols[base + start : end]
                kind = ends(piece)
                if kind is None:  # no token ends like this
                    break
                if kind:
                    tries.append((piece, start))
            found, place = None, -1
            for piece, start in reversed(tries):  # just one can stand; it is mostly the longest
                before = tokens[start]
                if before is not None:
                    good = pairs.get((before, piece)) if before else True
                    if good is None:
                        good = stable(before, piece)
                    if good:
                        found, place = piece, start
                        break
            # None: the token would start before what is pending, and no later token begins here.
            tokens.append(found)
            starts.append(place)
            if end in BEGINNINGS and end < len(symbols):
                if len(self.begun) >= BEGUN:
                    self.begun.clear()
                self.begun[symbols[:end]] = (starts.copy(), tokens.copy())
            if at >= mark and found is not None:
                self.most_pending = max(self.most_pending, at)
                final = self._settled(at, starts)
                if final:
                    gone = self._leave(final, starts, tokens)
                    out += [code[t] for t in gone]
                    starts = [-1, *(x - final for x in starts[final + 1 :])]
                    tokens = [gone[-1], *(t if x >= 0 else None for t, x in zip(tokens[final + 1 :], starts[1:], strict=True))]
                    base += final
                mark = self.lookahead + WINDOW
        if tokens[-1] is None:
            raise ValueError("a text without tokens")
        out += [code[t] for t in self._leave(len(tokens) - 1, starts, tokens)]
        return b"".join(out)


class Tokenizer:
    """A tokenizer file of kind BPE: NFC and lower case, words by a pattern, byte-level symbols, an end mark on words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError("not a BPE tokenizer")
        kinds = [x["type"] for x in self._list(spec["normalizer"], "normalizers")]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        split = next(x for x in self._list(spec["pre_tokenizer"], "pretokenizers") if x["type"] == "Split")
        if not (split["invert"] and split["behavior"] == "Removed") or "ByteLevel" not in str(spec["pre_tokenizer"]):
            raise ValueError("words must be what the pattern finds, in byte-level symbols")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.spaced = split["pattern"]["Regex"] in SPACED
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"] or []}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        suffix = model["end_of_word_suffix"] or ""
        self.end = bool(suffix)
        vocab = model["vocab"]
        self.merges = Merges(vocab, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], suffix)
        self.transducer = Transducer(self.merges)
        alphabet = byte_alphabet()
        self.symbols = str.maketrans({chr(b): c for b, c in enumerate(alphabet)})
        self.seen: dict[str, bytes] = {}  # parts met of late, and before: parts in use stay
        self.older: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}  # and the same for words
        self.known_before: dict[str, bytes] = {}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names[i].encode() if i in names else b"" for i in range(max(names) + 1)]
        back = {c: b for b, c in enumerate(alphabet)}

        def raw(i: int, token: str) -> bytes:
            if token in self.special:
                return token.encode()
            ends = bool(suffix) and token.endswith(suffix) and len(token) > len(suffix)
            return bytes(back[c] for c in (token[: -len(suffix)] if ends else token)) + (b" " if ends else b"")

        self._raw = lambda: [raw(i, names[i]) if i in names else b"" for i in range(max(names) + 1)]
        self.raw: list[bytes] | None = None  # made when texts are first asked for

    @staticmethod
    def _list(node: dict | None, inner: str) -> list[dict]:
        return [] if node is None else node[inner] if node["type"] == "Sequence" else [node]

    def _parts(self, text: str) -> Iterator[list[str]]:
        """A text in order, as stretches between spaces or as words: of a long one a few thousand at a time."""
        if not self.spaced:
            found = (m.group(1 if self.pattern.groups else 0) for m in self.pattern.finditer(text))
            while some := list(islice(found, STEP)):
                yield some
            return
        at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= LONG else text.find(" ", at + LONG) + 1 or len(text)
            yield text[at:end].replace("\n", " ").split(" ")
            at = end

    def _word(self, word: str) -> bytes:
        symbols = word.encode().decode("latin-1").translate(self.symbols)
        if self.end:
            symbols = symbols[:-1] + chr(END_PLANE + ord(symbols[-1]))
        return self.transducer.word(symbols)

    def _part(self, part: str) -> bytes:
        """The ids of a stretch not met of late: its words are looked for among all words met of late."""
        words, known = self.pattern.findall(part) if self.spaced else [part], self.known
        for w in words:
            if w not in known:
                ids = self.known_before.get(w)
                known[w] = self._word(w) if ids is None else ids
        ids = b"".join([known[w] for w in words])
        if len(known) > WORDS:
            self.known_before, self.known = known, {}
        return ids

    def _plain(self, text: str) -> Iterator[bytes]:
        if self.nfc and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = "σ".join(part.lower() for part in text.split("Σ"))  # one character at a time: never a final sigma
        for parts in self._parts(text):
            seen = self.seen
            for w in set(parts).difference(seen):
                ids = self.older.get(w)
                seen[w] = self._part(w) if ids is None else ids
            yield b"".join([seen[w] for w in parts])
            if len(seen) > WORDS:
                self.older, self.seen = seen, {}

    def pieces(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, piece by piece. Special tokens' strings in the text become these tokens."""
        if self.cut is None or not any(s in text for s in self.special):
            yield from self._plain(text)
            return
        for p in self.cut.split(text):
            if p in self.special:
                yield self.special[p].to_bytes(4, "little")
            elif p:
                yield from self._plain(p)

    def encode(self, text: str) -> bytes:
        """All ids of a text."""
        return b"".join(self.pieces(text))

    def reader(self, *, as_text: bool = False) -> Callable[..., str]:
        """Takes ids piece by piece and gives their text so far: the tokens' names joined by spaces, as the library does for a file
        without a decoder; ``as_text`` gives their texts, a word end as a space. Bytes go through an incremental UTF-8 machine that
        holds back unfinished characters; the last call says so."""
        machine, begun = codecs.getincrementaldecoder("utf-8")("replace"), False
        if as_text and self.raw is None:
            self.raw = self._raw()
        table = self.raw if as_text else self.names

        def read(ids: bytes, last: bool = False) -> str:
            nonlocal begun
            piece = (b"" if as_text else b" ").join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
            gap = b" " if begun and ids and not as_text else b""
            begun = begun or bool(ids)
            return machine.decode(gap + piece, last)

        return read

    def decode(self, ids: bytes, *, as_text: bool = False) -> str:
        """The text of all ids, a few thousand at a time."""
        read = self.reader(as_text=as_text)
        return "".join([read(ids[k : k + 4 * STEP]) for k in range(0, len(ids), 4 * STEP)] + [read(b"", True)])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def vocabulary_path(name: str) -> str:
    """Where this machine keeps a public vocabulary file; asked for on each executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, vocabulary: str, *, text: str = "text") -> DataFrame:
    """``doc_id, ids`` (binary, little-endian unsigned 32-bit): whole texts, null as empty. One row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary_path(vocabulary))
        for rows in batches:
            ids = pa.array([t.encode(x) for x in rows["body"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([rows["doc_id"], ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body")).mapInArrow(run, "doc_id long, ids binary")


def token_report(docs: DataFrame, vocabulary: str, *, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row per input row; decoding starts from the ids alone. Null texts count as empty; repeated rows are encoded
    alike, texts of any length whole; an empty table gives no rows, and other columns are ignored."""

    def digests(t: Tokenizer, body: str) -> tuple[int, str, str]:
        """Each piece of ids is hashed and read back as it comes, so a text needs no more memory than itself."""
        n, ids_sha, text_sha, read = 0, hashlib.sha256(), hashlib.sha256(), t.reader()
        for ids in t.pieces(body):
            n += len(ids) // 4
            ids_sha.update(ids)
            text_sha.update(read(ids).encode())
        text_sha.update(read(b"", True).encode())
        return n, ids_sha.hexdigest(), text_sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary_path(vocabulary))
        for rows in batches:
            told = [digests(t, x.as_py()) for x in rows["body"]]
            columns = [pa.array([x[i] for x in told], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([rows["doc_id"], *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
