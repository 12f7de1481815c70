"""Text that was decoded with the wrong character encoding: find it, and restore it.

Two kinds of damage are told apart:

* UTF-8 bytes read as another encoding leave sequences that no language writes.
  They are precomputed for all encodings and characters, and found by one
  automaton; only matched spans are replaced, so correct text beside them stays.
* Bytes of one 8-bit encoding read as another leave single wrong letters. The
  garbled words are precomputed the other way round: every suspicious word is
  decoded back under all pairs, and a pair holds where the whole corpus knows the
  restored word far better than the garbled one, by itself or together with the
  other words of its text (counts over documents, and over distinct texts).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

# The encodings in which UTF-8 is misread, likely ones first.
MISREAD = [
    "cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "gbk", "koi8_r", "cp866",
    "iso8859_2", "iso8859_15", "cp852", "cp1253", "cp1254", "cp1257", "shift_jis", "big5",
]
EAST = {"gbk", "shift_jis", "big5"}
# 8-bit encodings that are taken for one another.
EIGHT_BIT = ["cp1252", "cp1250", "cp1251", "koi8_r", "mac_roman", "cp437", "cp850", "cp866", "iso8859_2"]
# Signs that running text uses beside its letters.
SIGNS = "‘’‚“”„–—…•«»‹›¿¡×°§€£™→←©®·"
# Signs that may stand before an accented letter by themselves.
_MAY_LEAD = set("–—‘’“”…•«»„‚œŒƒ·")


def _characters() -> list[str]:
    """The characters whose garbled forms are looked for, by block."""
    spans = [(0xA0, 0x17F), (0x192, 0x192), (0x218, 0x21B), (0x2C6, 0x2C7), (0x2D8, 0x2DD), (0x386, 0x3CE), (0x401, 0x45F), (0x490, 0x491), (0x2010, 0x203A), (0x20AC, 0x20AC), (0x2122, 0x2122), (0x2190, 0x2193),
             (0x2212, 0x2212), (0x2248, 0x2265), (0x2500, 0x2501), (0x25A0, 0x25CF), (0x2713, 0x2717), (0xFB01, 0xFB02), (0xFEFF, 0xFEFF), (0x1F300, 0x1F6FF), (0x1F900, 0x1F9FF)]
    return [chr(c) for a, b in spans for c in range(a, b + 1) if unicodedata.category(chr(c)) != "Cn"]


# The encodings whose signs and letters show UTF-8 of any character of the basic plane.
ANY_CHARACTER = ["cp1252", "latin_1", "mac_roman", "cp437", "cp850", "iso8859_15"]
_NO_CHARACTER = {"Cn", "Co", "Cs"}


def _odd(ch: str) -> bool:
    """A character that running text has neither as a letter nor as one of its usual signs."""
    return ch in "ªº" or not (ch.isalpha() or ch in SIGNS or ch == "\xa0")


def _stands_out(chars: str, enc: str) -> bool:
    """Not all of it are letters and usual signs, nor, where an encoding has them, lines of a drawing."""
    return any(map(_odd, chars)) and not (enc in ("cp437", "cp850") and _lines(chars))


@lru_cache(1)
def _byte_of() -> dict[str, dict[str, int]]:
    """For each of these encodings the byte that shows as a character."""
    return {enc: {_read(bytes([b]), enc, None): b for b in range(0x80, 0x100)} for enc in ANY_CHARACTER}


def _encoded(chars: str, enc: str) -> str:
    """The assigned characters whose UTF-8 shows as chars in enc; empty if they are none."""
    try:
        was = bytes(_byte_of()[enc][c] for c in chars).decode()
    except (KeyError, UnicodeDecodeError):
        return ""
    return "" if any(unicodedata.category(c) in _NO_CHARACTER for c in was) else was


def _one_layer(run: list[tuple], text: str) -> list[tuple]:
    """The hits of a run as those of one encoding in which all of it is UTF-8; else as they are.

    So of text that was garbled several times one layer goes with each round. What
    would be an unusual character counts only where no usual one was found.
    """
    start, end = run[0][0], run[-1][1]
    unusual = any(h[3] in ANY_CHARACTER and h[2] not in _usual() for h in run)
    for enc in ANY_CHARACTER:
        was = _encoded(text[start:end], enc)
        if was and (unusual or all(c in _usual() or "\x80" <= c <= "\x9f" for c in was)):
            out, at = [], start
            for c in was:
                seq = text[at : (at := at + len(c.encode()))]
                known = garbled_sequences().get(seq)
                sure = known[2] if known and known[0] == c else len(seq) > 2 and seq[0] not in SIGNS and any(map(_odd, seq))
                out.append((at - len(seq), at, c, enc, sure))
            return out
    return run


@lru_cache(None)
def _shown_as(enc: str) -> list[str | None]:
    """The character of each single byte in an encoding."""
    out: list[str | None] = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(enc))
        except UnicodeDecodeError:
            out.append(None)
    return out


def _read(raw: bytes, enc: str, lost: str | None) -> str:
    """raw in enc; what enc does not define becomes its control character, or `lost`."""
    shown = _shown_as(enc)
    return "".join([shown[b] or (chr(b) if lost is None else lost) for b in raw])


@lru_cache(1)
def _usual() -> frozenset[str]:
    return frozenset(_characters())


def _bare(ch: str) -> str:
    """UTF-8 read as latin_1, with the control characters stripped afterwards."""
    return "".join(c for c in ch.encode().decode("latin_1") if not "\x80" <= c <= "\x9f")


@lru_cache(1)
def _lost_to() -> dict[str, str]:
    """What is left of characters whose control characters were stripped, to those characters."""
    out: dict[str, str] = {}
    for ch in _characters():
        if len(left := _bare(ch)) < len(ch.encode()) and ord(ch) < 0x2200:
            out[left] = out.get(left, "") + ch
    return out


# Stands for the characters of three bytes that a sequence of two begins.
_BEGINS = "..."


@lru_cache(1)
def garbled_sequences() -> dict[str, tuple[str, str, bool]]:
    """Garbled sequence to (what it was, the encoding, whether it is proof by itself).

    Whole sequences of the usual characters in all encodings; those of all other
    characters of the basic plane by their first two bytes, in the encodings in
    which they do not look like words.
    """
    found: dict[str, tuple[str, str, bool]] = {}

    def add(seq: str | None, was: str, enc: str, sure: bool) -> None:
        if seq and seq not in found and seq != was:
            found[seq] = (was, enc, sure)

    def proof(seq: str) -> bool:
        signs = any(not unicodedata.category(c).startswith("L") for c in seq[1:]) or unicodedata.category(seq[0])[0] != "L"
        return len(seq) >= 3 or (signs and seq[0] not in _MAY_LEAD)

    chars = _characters()
    for enc in MISREAD:
        western = enc in ("cp1252", "latin_1")
        for ch in chars:
            raw = ch.encode()
            if enc in EAST:
                for tail in [b""] if len(raw) % 2 == 0 else [bytes([a]) for a in range(0x40, 0x7B)]:
                    try:
                        seq = (raw + tail).decode(enc)
                    except UnicodeDecodeError:
                        continue
                    if not seq.isascii() and len(seq) * 2 <= len(raw + tail):
                        add(seq, ch + tail.decode(), enc, len(seq) > 1)
                continue
            if enc == "latin_1":
                bare = _bare(ch)
                if len(bare) > 1:
                    add(bare, _lost_to().get(bare, "") and ch, enc, True)
            for lost in (None, "", "�"):
                seq = _read(raw, enc, lost)
                if len(seq) < 2 or seq.isascii() or any(c.isascii() for c in seq):
                    continue
                add(seq, ch if lost is None or len(seq) == len(raw) and "�" not in seq else "", enc, (western and seq[0] not in _MAY_LEAD) or (proof(seq) and (len(raw) < 4 or len(seq) > 2)))
                if western:
                    twice = _read(seq.encode(), enc, lost)
                    add(twice, ch if lost is None else "", enc, True)
                    if lost is None and ord(ch) < 0x2200:
                        add(_read(twice.encode(), enc, lost), ch, enc, True)
    # Characters of the basic plane beyond those: two bytes whole, of three bytes the first two.
    for enc in ANY_CHARACTER:
        for raw in range(0xC2, 0xF0):
            for more in range(0x80, 0xC0):
                seq = _read(bytes([raw, more]), enc, None)
                if raw < 0xE0:
                    if was := _encoded(seq, enc):
                        add(seq, was, enc, False)
                elif seq not in found:
                    found[seq] = (_BEGINS, enc, False)
    for b in range(0x80, 0xA0):
        try:
            add(chr(b), bytes([b]).decode("cp1252"), "latin_1", b != 0x85)
        except UnicodeDecodeError:
            add(chr(b), "", "latin_1", True)
    add("�", "", "utf_8", True)
    return found


@lru_cache(1)
def _first_sight() -> re.Pattern:
    """One to four characters with which every garbled sequence that counts begins; few correct texts have them.

    Of an unusual character's two bytes only another such pair right after it can make one count.
    """
    leads, seconds, single, opening, inner, weak, after = set(), set(), set(), set(), set(), set(), set()
    for seq, (was, enc, _) in garbled_sequences().items():
        if was == _BEGINS:
            opening.add(seq[0])
            inner.add(seq[1])
        elif len(seq) == 2 and enc in ANY_CHARACTER and was and was not in _usual():
            weak.add(seq[0])
            after.add(seq[1])
        elif len(seq) > 1 and enc not in EAST:
            leads.add(seq[0])
            seconds.add(seq[1])
        else:
            single.add(seq[0])
    group = lambda x: "[" + "".join(map(re.escape, sorted(x))) + "]"
    pair = group(weak) + group(after)
    return re.compile(f"{group(leads)}{group(seconds)}|{group(opening)}{group(inner)}{{2}}|{pair}{pair}|{group(single)}")


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for seq, (was, enc, sure) in garbled_sequences().items():
        a.add_word(seq, (len(seq), was, enc, sure))
    a.make_automaton()
    return a


_ENTITY = re.compile(r"&#(?:(\d{3,7})|[xX]([0-9a-fA-F]{2,6}));")
_CODE = re.compile(r"`[^`\n]*`")
_LONE_A = re.compile(r"(?<=[a-zß-ÿ]\s)Ã(?=[\s ][a-zß-ÿ`])")


def _entity(m: re.Match) -> str:
    """The character of a numeric entity, in decimals or hex; the entity itself if it is ASCII or none."""
    code = int(m[1]) if m[1] else int(m[2], 16)
    return chr(code) if 128 <= code < 0xD800 or 0xE000 <= code < 0x110000 else m[0]


def _unescaped(text: str) -> str:
    return _ENTITY.sub(_entity, text) if "&#" in text else text


def _places(text: str) -> list[int] | None:
    """Where each character of _unescaped(text) begins in text, and its end; null if there are no entities."""
    if "&#" not in text:
        return None
    out, at = [], 0
    for m in _ENTITY.finditer(text):
        if len(_entity(m)) == 1:
            out += [*range(at, m.start()), m.start()]
            at = m.end()
    return [*out, *range(at, len(text) + 1)]


def _is_east(ch: str) -> bool:
    return "⺀" <= ch <= "鿿" or "가" <= ch <= "힣" or "｡" <= ch <= "ﾟ"


def _shown(text: str, a: int, b: int) -> bool:
    """The span is all that stands between two code marks or quotes: an example that is talked about."""
    before, after = text[a - 1 : a], text[b : b + 1]
    return (before, after) in (("`", "`"), ('"', '"'), ("'", "'"), ("“", "”"), ("«", "»"), ("„", "“"))


def _lines(chars: str) -> bool:
    return all("─" <= c <= "▟" for c in chars)


def _drawn(text: str, a: int, b: int) -> bool:
    """The span consists of lines of a drawing, and another one stands beside it."""
    return _lines(text[a:b]) and (a > 0 and _lines(text[a - 1]) or b < len(text) and _lines(text[b]))


def garbled_spans(text: str) -> list[tuple[int, int, str, bool]]:
    """start, end, original ('' where it is lost) and restorable of each garbled span.

    A sequence that could be correct by itself counts only beside another of its
    encoding, or in a text that has sure ones of it; lines of a drawing not beside
    other lines; one of a character beyond the usual ones only beside another, where
    not all are letters and usual signs. What is shown as an example, alone between
    code marks or quotes, does not count.
    """
    if not _first_sight().search(text):
        return []
    longest: dict[int, tuple] = {}
    for last, (n, was, enc, sure) in _automaton().iter(text):
        start, end = last - n + 1, last + 1
        if was == _BEGINS:
            for enc in ANY_CHARACTER:
                if len(was := _encoded(text[start : end + 1], enc)) == 1:
                    break
            else:
                continue
            end += 1
        if start not in longest or end > longest[start][1]:
            longest[start] = (start, end, was, enc, sure)
    hits: list[tuple] = []
    for start in sorted(longest):
        if not hits or start >= hits[-1][1]:
            hits.append(longest[start])
    if not hits:
        return []
    runs: list[list[tuple]] = []
    for h in hits:
        if runs and runs[-1][-1][1] == h[0]:
            runs[-1].append(h)
        else:
            runs.append([h])
    runs = [r for r in runs if not _shown(text, r[0][0], r[-1][1]) and not _drawn(text, r[0][0], r[-1][1])]
    if not runs:
        return []
    runs = [_one_layer(r, text) for r in runs]
    sure_in = Counter(h[3] for r in runs for h in r if h[4])
    east = sum(map(_is_east, text))
    covered = sum(_is_east(c) for r in runs for h in r if h[3] in EAST for c in text[h[0] : h[1]])
    out = []
    for r in runs:
        for s, e, was, enc, sure in r:
            same = sum(h[3] == enc for h in r)
            if not sure and was and enc in ANY_CHARACTER and was not in _usual():
                if same >= 2 and _stands_out(text[r[0][0] : r[-1][1]], enc):
                    out.append((s, e, was, True))
            elif sure or (sure_in[enc] > 0) or (same >= 2 if enc not in EAST else covered == east):
                out.append((s, e, was, bool(was)))
    return out


def restore(text: str) -> tuple[str, int, bool]:
    """The text with its garbled spans replaced, how many there were, and whether all could be.

    Spans whose original is lost stay as they are, and so does everything beside
    the spans: an entity is read only as a part of one. Repeats until no span is
    left that can be replaced, so text garbled any number of times comes back
    whole. Each round leaves fewer characters that are not ASCII, or fewer control
    characters, so it ends.
    """
    n, whole = 0, True
    while spans := garbled_spans(_unescaped(text)):
        at = _places(text)
        parts, done = [], 0
        whole = all(ok for *_, ok in spans)
        for s, e, was, ok in spans:
            start, end = (at[s], at[e]) if at else (s, e)
            parts += [text[done:start], was if ok else text[start:end]]
            done = end
        n += len(spans)
        text = "".join(parts) + text[done:]
        if not any(ok for *_, ok in spans):
            break
    return text, n, whole


# Ids with their few words; more than that meet the texts in a shuffled join.
BROADCAST_IDS = 100_000
BROADCAST_ROWS = 500_000
_EDGE = re.compile(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")


@lru_cache(200_000)
def paired_readings(word: str) -> tuple[tuple[int, str], ...]:
    """What each 8-bit mix-up could have made this word of: pair (-1: a part was lost) and reading.

    Only readings in natural spelling. Words of ordinary signs alone have none,
    and a single letter none but signs.
    """
    if all(c in SIGNS for c in word):
        return ()
    out = [(-1, w) for w in _refilled(word) if _natural(w)]
    for i, wrong in enumerate(EIGHT_BIT):
        try:
            raw = word.encode(wrong)
        except UnicodeEncodeError:
            continue
        for j, right in enumerate(EIGHT_BIT):
            if right == wrong:
                continue
            try:
                was = raw.decode(right)
            except UnicodeDecodeError:
                continue
            if was != word and _natural(was):
                out.append((i * len(EIGHT_BIT) + j, was))
    return tuple((pair, w) for pair, w in out if len(word) > 1 or not w.isalpha())


def restored_words(word: str) -> tuple[str, ...]:
    """The readings of a word under any pair."""
    return tuple(dict.fromkeys(was for _, was in paired_readings(word)))


def _refilled(word: str) -> list[str]:
    """Readings of a word in which characters have lost a part (as in `Itâs`).

    Two such characters are read in all ways; of more, equal ones are read alike.
    """
    lost = [(i, c) for i, c in enumerate(word) if c in _lost_to()]
    if not lost:
        return []
    if len(lost) > 2:
        kinds = sorted({c for _, c in lost})
        return [word.translate(dict(zip(map(ord, kinds), was))) for was in product(*(_lost_to()[c] for c in kinds))] if len(kinds) < 3 else []
    out = []
    for first in _lost_to()[lost[0][1]]:
        for last in _lost_to()[lost[-1][1]] if len(lost) > 1 else first:
            chars = list(word)
            chars[lost[0][0]] = first
            chars[lost[-1][0]] = last
            out.append("".join(chars))
    return out


def _natural(word: str) -> bool:
    """One script, letters and usual signs only, lower, upper or title case."""
    letters = [c for c in word if c.isalpha()]
    if any(not (c.isascii() or c.isalpha() or c in SIGNS) for c in word) or any(c in "ªº" for c in word):
        return False
    cyrillic = {"Ѐ" <= c <= "џ" for c in letters if not c.isascii()}
    if len(cyrillic) > 1 or cyrillic == {True} and any(c.isascii() for c in letters):
        return False
    for part in re.split(r"[^\w]+", word):
        if part and not (part.islower() or part.isupper() or part.istitle() or part.isdigit() or part.isascii()):
            return False
    return True


# A sign by itself between two words, or between two numbers.
_ALONE = re.compile(r"([^\s,:;]) ([^\x00-\x7f\s]) (?=(\S))")

_PASS = "doc_id long, content long, word string, sizes boolean, n long, n_texts long, n_spans int"
_PASS_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("content", pa.int64()), ("word", pa.string()), ("sizes", pa.bool_()), ("n", pa.int64()), ("n_texts", pa.int64()), ("n_spans", pa.int32())]
)


def suspicious_words(text: str) -> tuple[set[str], list[tuple[str, bool]]]:
    """The words of a text that are not ASCII, and those that may be garbled.

    A sign by itself is only suspicious between two words, or two numbers (sizes).
    """
    tokens = {w for w in text.split() if not w.isascii()}
    if any("`" in w for w in tokens):
        tokens = {w for w in _CODE.sub(" ", text).split() if not w.isascii()}
    seen = {_EDGE.sub("", w) for w in tokens}
    maybe = [(word, False) for word in seen if len(word) > 1 and paired_readings(word)]
    if any(len(w) == 1 for w in tokens):
        alone = {(m[2], m[1].isdigit() and m[3].isdigit()) for m in _ALONE.finditer(text)}
        maybe += [(word, sizes) for word, sizes in alone if paired_readings(word)]
    return seen, maybe


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One reading of the texts: garbled spans per document, word counts, suspicious words.

    Words are counted over documents, and over distinct texts by their first documents.
    """
    known: Counter = Counter()
    once: Counter = Counter()

    def rows(cols):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PASS_ARROW)], schema=_PASS_ARROW)

    def counted():
        n = len(known)
        return rows([[None] * n, [None] * n, list(known), [None] * n, list(known.values()), [once[w] for w in known], [None] * n])

    for batch in batches:
        cols: list[list] = [[] for _ in _PASS_ARROW]
        for doc, text, content, first in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if not text or (text.isascii() and "&#" not in text):
                continue
            text = _unescaped(text)
            n = len(garbled_spans(text)) or len(_LONE_A.findall(text))
            seen, maybe = suspicious_words(text)
            known.update(seen)
            if first:
                once.update(seen)
            for row in ([(doc, None, None, None, None, None, n)] if n else []) + [(doc, content, w, sizes, None, None, None) for w, sizes in maybe]:
                for to, value in zip(cols, row):
                    to.append(value)
        yield rows(cols)
        if len(known) > 200_000:
            yield counted()
            known.clear()
            once.clear()
    yield counted()


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each suspicious word with everything it may have been, by pair of encodings; readings that are garbled themselves are none."""
    schema = pa.schema([("word", pa.string()), ("sizes", pa.bool_()), ("pair", pa.int32()), ("was", pa.string())])
    for batch in batches:
        rows = [
            (word, sizes, pair, was)
            for word, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for pair, was in paired_readings(word)
            if (len(word) > 1 or (was == "×") == sizes) and not garbled_spans(was)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)


def _first_of_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text, content (a hash of the text), and whether the document is the first with that text.

    Of copied texts one row of two numbers each is broadcast, up to BROADCAST_ROWS
    of them, so that no text is shuffled.
    """
    hashed = docs.withColumn("content", F.xxhash64("text"))
    first = hashed.groupBy("content").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last").select("content", "_first")
    copies = stage(first, "copies")
    return hashed.join(_small(copies), "content", "left").select("doc_id", "text", "content", F.coalesce(F.col("doc_id") == F.col("_first"), F.lit(True)).alias("first"))


def _together(maybe: DataFrame, judged: DataFrame, times: int, at_least: int) -> DataFrame:
    """The readings that the suspicious words of whole texts prove together.

    A text is suspected under a pair where the readings of two or more of its
    words are, multiplied, `times` as frequent as the words. What suspected texts
    hold does not count against a reading: a word is garbled where the readings,
    or the suspected texts with it, are `times` as many as its other texts.
    """
    key = ["word", "sizes", "pair"]
    odds = judged.where(F.col("right_texts") >= at_least).groupBy(*key, "n_texts").agg(F.max_by(F.struct("was", "n_right", "right_texts"), F.struct("right_texts", "was")).alias("r"))
    odds = stage(odds.select(*key, "n_texts", "r.*").withColumn("odds", F.log(F.col("right_texts") / F.greatest("n_texts", F.lit(1)))), "odds")
    words = maybe.select("content", "word", "sizes")
    enough = F.log(F.lit(float(times))) - 1e-9
    # Only texts whose likelier readings are enough by themselves can be suspected; the others need not be weighed.
    likelier = _small(odds.where("odds > 0").select(*key, "odds"))
    able = words.join(likelier, ["word", "sizes"]).distinct().groupBy("content", "pair").agg(F.sum("odds").alias("odds")).where(F.col("odds") >= enough).select("content", "pair")
    able = _small(stage(able, "able"))
    held = words.join(able, "content").distinct().join(odds.select(*key, "odds"), key)
    held = stage(held.select("content", *key, "odds"), "held")
    text = held.groupBy("content", "pair").agg(F.count_distinct("word").alias("k"), F.sum("odds").alias("odds"))
    suspected = text.where((F.col("k") > 1) & (F.col("odds") >= enough)).select("content", "pair")
    inside = held.join(suspected, ["content", "pair"]).groupBy(*key).agg(F.count("*").alias("inside"))
    other = times * (F.col("n_texts") - F.col("inside"))
    return odds.join(inside, key).where((F.col("right_texts") > F.col("n_texts")) & (other <= F.greatest("right_texts", "inside")))


def _small(df: DataFrame) -> DataFrame:
    """To be broadcast, if a count of its rows of a word or two numbers allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def find_garbled(docs: DataFrame, times: int = 10, at_least: int = 3) -> tuple[DataFrame, DataFrame]:
    """The affected documents (doc_id, n_spans), and the garbled words (doc_id, word, was).

    docs(doc_id, text) is read once for its words. A word counts as garbled where
    at least `at_least` documents or distinct texts, and at least `times` as many
    as have the word itself, have what it would be under the right encoding; or
    where the words of whole texts prove it together. Null and empty texts give no
    rows; repeated doc_ids count as one document; a null doc_id is left out.
    """
    read = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(r"[^\x00-\x7f]|&#"))
    seen = stage(_first_of_copies(read).mapInArrow(_pass, _PASS), "encodings")
    spans = seen.where("n_spans is not null").groupBy("doc_id").agg(F.max("n_spans").alias("n_spans"))
    known = seen.where("n is not null").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_texts").alias("n_texts"))
    maybe = seen.where("sizes is not null").select("doc_id", "content", "word", "sizes")
    pairs = maybe.select("word", "sizes").distinct().mapInArrow(_readings, "word string, sizes boolean, pair int, was string")
    right = known.select(F.col("word").alias("was"), F.col("n").alias("n_right"), F.col("n_texts").alias("right_texts")).where(F.col("n_right") >= at_least)
    judged = stage(pairs.join(right, "was").join(known, "word"), "readings")
    by_texts = (F.col("right_texts") >= at_least) & (F.col("right_texts") >= times * F.col("n_texts"))
    alone = judged.where((F.col("n_right") >= times * F.col("n")) | by_texts)
    proven = alone.select("word", "sizes", "was", "n_right").unionByName(_together(maybe, judged, times, at_least).select("word", "sizes", "was", "n_right"))
    best = proven.groupBy("word", "sizes").agg(F.max_by("was", F.struct("n_right", "was")).alias("was"))
    return spans, maybe.join(_small(stage(best, "proven")), ["word", "sizes"]).select("doc_id", "word", "was").distinct()


def garbled_documents(docs: DataFrame) -> DataFrame:
    spans, words = find_garbled(docs)
    return spans.select("doc_id").unionByName(words.select("doc_id")).distinct()


def restored_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_spans, restorable, found_by of the affected documents.

    Restorable is false where a part of the original is lost; that part stays.
    found_by tells what found the document: `sequences` of the automaton, `words`
    that the corpus knows far better restored, or `both`. The found ids are
    broadcast up to BROADCAST_IDS of them, so that no text is shuffled.
    """
    spans, words = find_garbled(docs)
    per_doc = words.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "was"))).alias("words"))
    by = F.when(F.col("words").isNull(), "sequences").when(F.col("n_spans").isNull(), "words").otherwise("both")
    hit = stage(spans.join(per_doc, "doc_id", "full").select("doc_id", "words", by.alias("found_by")), "garbled")
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_IDS else hit
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(hit, "doc_id")

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, text, known, found_by in zip(pdf["doc_id"], pdf["text"], pdf["words"], pdf["found_by"]):
                text, n, ok = restore(text)
                known = dict(known) if known is not None else {}
                if known:
                    edge = r"(?<![^\s!-/:-@\[-`{-~])"
                    pattern = edge + "(?:" + "|".join(map(re.escape, sorted(known, key=len, reverse=True))) + r")(?![^\s!-/:-@\[-`{-~])"
                    text, k = re.subn(pattern, lambda m: known[m[0]], text)
                    n += k
                rows.append((doc, text, n, ok, found_by))
            yield pdf.drop(columns=list(pdf.columns)).assign(**{c: [r[i] for r in rows] for i, c in enumerate(("doc_id", "text", "n_spans", "restorable", "found_by"))})

    return whole.mapInPandas(run, "doc_id long, text string, n_spans int, restorable boolean, found_by string")
