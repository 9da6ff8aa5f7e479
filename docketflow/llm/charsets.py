"""Wrong decodings as character tables inferred from aligned text, in plain Python for use inside Arrow batches.

A wrong reading of UTF-8 is a table from each character shown to the byte it
stands for; one of single-byte text is a table from each character shown to the
one meant. Tables come from aligned characters only. Where the characters of a
codec of the platform agree with what was aligned, it completes the table with
the characters not met so far; tables that fit no codec are used as they are.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import lru_cache

LOST = "�"
RUN = re.compile(r"[^\x00-\x7f]+")
#: Aligned characters from which a wrong reading of UTF-8, or of single-byte text, is believed: by chance, one or two fit some codec.
LEAST_UTF8, LEAST_SINGLE = 3, 4


@lru_cache(maxsize=1)
def platform_codecs() -> dict[str, tuple[dict[str, int], dict[int, str]]]:
    """Every single-byte codec of the platform that extends ASCII: characters to bytes, bytes to characters."""
    from encodings.aliases import aliases

    out = {}
    ascii_bytes = bytes(range(0x20, 0x7F))
    for name in sorted(set(aliases.values())):
        chars: dict[int, str] = {}
        try:
            if ascii_bytes.decode(name) != ascii_bytes.decode("ascii"):
                continue
            for b in range(0x80, 0x100):
                char = bytes([b]).decode(name, "ignore")
                if len(char) == 1:
                    chars[b] = char
        except (LookupError, UnicodeError, TypeError, ValueError):
            continue
        if len(chars) >= 96:
            out[name] = ({c: b for b, c in chars.items()}, chars)
    return out


def align_utf8(shown: str, meant: str) -> list[tuple[str, str]]:
    """(characters shown, character meant) for each character of ``meant``, if ``shown`` can be its UTF-8 bytes read one by one; else none."""
    sizes = [len(c.encode("utf-8", "surrogatepass")) for c in meant]
    if sum(sizes) != len(shown) or LOST in shown or LOST in meant:
        return []
    out, at = [], 0
    for c, n in zip(meant, sizes):
        out.append((shown[at : at + n], c))
        at += n
    bytes_of: dict[str, int] = {}
    if any(bytes_of.setdefault(x, b) != b for seq, c in out for x, b in zip(seq, c.encode())):
        return []  # one character would stand for two bytes
    return out


def align_single(shown: str, meant: str) -> list[tuple[str, str]]:
    """(character shown, character meant) pairs of runs of equal length; none if one character would mean two."""
    if len(shown) != len(meant) or shown == meant or LOST in shown or LOST in meant:
        return []
    table: dict[str, str] = {}
    if any(table.setdefault(x, y) != y for x, y in zip(shown, meant)):
        return []
    return list(table.items())


def _with_controls(table: dict[str, int]) -> dict[str, int]:
    """Bytes that a codec leaves undefined show as the control characters of that number."""
    return {chr(b): b for b in range(0x80, 0xA0)} | table


def _agreed(tables: Iterable[dict]) -> dict:
    """One table of equally well supported ones: what none of them contradicts."""
    out, apart = {}, set()
    for table in tables:
        apart |= {c for c, x in table.items() if out.setdefault(c, x) != x}
    return {c: x for c, x in out.items() if c not in apart}


def infer_utf8(aligned: dict[tuple[str, str], int]) -> list[dict[str, int]]:
    """Tables of characters to bytes from counts of aligned (sequence shown, character meant), best supported first."""
    left = {pair: n for pair, n in aligned.items()}
    tables: list[dict[str, int]] = []
    codecs = platform_codecs()
    while left:
        score: Counter = Counter()
        explained: dict[str, set] = defaultdict(set)
        for (seq, char), n in left.items():
            raw = char.encode()
            for name, (to_byte, _) in codecs.items():
                if all(to_byte.get(x, ord(x) if x < "\xa0" else -1) == b for x, b in zip(seq, raw)):
                    score[name] += n
                    explained[name] |= set(zip(seq, raw))
        fits = [name for name in score if len(explained[name]) >= LEAST_UTF8]
        if not fits:
            break
        most = max(score[name] for name in fits)
        tables.append(_with_controls(_agreed(codecs[name][0] for name in sorted(fits) if score[name] == most)))
        left = {pair: n for pair, n in left.items() if not all(tables[-1].get(x, -1) == b for x, b in zip(pair[0], pair[1].encode()))}
    # what a known table reads otherwise was aligned with another text's character
    left = {pair: n for pair, n in left.items() if not any(pair[0][0] in t and t[pair[0][0]] == pair[1].encode()[0] for t in tables)}
    return tables + _own_tables(left)


def _own_tables(aligned: dict[tuple[str, str], int]) -> list[dict[str, int]]:
    """Tables of no known codec: pairs are united while they share a character and contradict in none."""
    found: list[tuple[dict[str, int], set]] = []
    for (seq, char), _ in sorted(aligned.items(), key=lambda x: (-x[1], x[0])):
        pairs = dict(zip(seq, char.encode()))
        shared = [sum(t.get(x) == b for x, b in pairs.items()) for t, _ in found]
        clash = [sum(t.get(x, b) != b for x, b in pairs.items()) for t, _ in found]
        free = [k for k in range(len(found)) if shared[k] and not clash[k]]
        if free:
            k = max(free, key=lambda k: shared[k])
            found[k][0].update(pairs)
            found[k][1].add(char)
        elif not any(s and s >= c for s, c in zip(shared, clash)):
            found.append((pairs, {char}))
    k = 0
    while k < len(found):
        table, chars = found[k]
        same = next((j for j in range(k) if table.items() & found[j][0].items() and not any(found[j][0].get(x, b) != b for x, b in table.items())), None)
        if same is None:
            k += 1
            continue
        found[same][0].update(table)
        found[same][1].update(chars)
        del found[k]
        k = 0
    # a byte shows as one character; more than a few that share one were aligned by chance
    good = [(t, chars) for t, chars in found if len(t) >= LEAST_UTF8 and len(chars) > 1 and len(set(t.values())) >= 0.8 * len(t)]
    return [t for t, _ in sorted(good, key=lambda x: -len(x[0]))]


def infer_single(aligned: dict[tuple[str, str], int]) -> list[dict[str, str]]:
    """Tables of characters shown to characters meant from counts of aligned (shown, meant), best supported first."""
    left, tables, codecs = dict(aligned), [], platform_codecs()
    while left:
        score: Counter = Counter()
        explained: Counter = Counter()
        for (shown, meant), n in left.items():
            for wrong, (to_byte, _) in codecs.items():
                b = to_byte.get(shown)
                for right, (_, to_char) in codecs.items() if b is not None else ():
                    if to_char.get(b) == meant:
                        score[wrong, right] += n
                        explained[wrong, right] += 1
        fits = [pair for pair in score if explained[pair] >= LEAST_SINGLE]
        if not fits:
            break
        most = max(score[pair] for pair in fits)
        best = [pair for pair in sorted(fits) if score[pair] == most]
        tables.append(_agreed({c: codecs[right][1][b] for c, b in codecs[wrong][0].items() if b in codecs[right][1]} for wrong, right in best))
        left = {(x, y): n for (x, y), n in left.items() if tables[-1].get(x) != y}
    # what is left, as far as both directions are nearly unambiguous
    by_shown, by_meant = Counter(), Counter()
    for (x, y), n in left.items():
        by_shown[x] += n
        by_meant[y] += n
    own = {x: y for (x, y), n in left.items() if n >= 0.8 * max(by_shown[x], by_meant[y]) and x.isalpha() and y.isalpha() and not any(x in t for t in tables)}
    return tables + ([own] if len(own) >= LEAST_SINGLE else [])


def stripped_runs(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without its non-ASCII characters, and each run of them with its place in that."""
    plain, at, length, found = [], 0, 0, []
    for m in RUN.finditer(text):
        plain.append(text[at : m.start()])
        length += m.start() - at
        found.append((length, m[0]))
        at = m.end()
    return "".join(plain) + text[at:], found


_WORD = re.compile(r"\S+")


def word_sides(text: str) -> list[tuple[str, str, int]]:
    """(side, run, number of the run): each run with the stripped word it stands in, or with the words around a word without ASCII characters."""
    out, k = [], 0
    words = _WORD.findall(text)
    for i, word in enumerate(words):
        bare, runs = stripped_runs(word)
        if not bare and runs:
            bare = f"{words[i - 1] if i else ''}\x00\x00{words[i + 1] if i + 1 < len(words) else ''}"
        for place, run in runs:
            out.append((f"{bare}\x00{place}", run, k))
            k += 1
    return out


class Repairer:
    """Applies learned tables to one text after the other.

    known: counts of the characters of the corpus's runs; pairs: counts of their
    neighbouring letters, which decide about readings of equal length.
    """

    def __init__(self, multi: list[dict[str, int]], single: list[dict[str, str]], known: dict[str, int], pairs: dict[str, int]):
        self.multi, self.single = multi, single
        self.known, self.pairs, self.total = known, pairs, sum(pairs.values()) + 1
        self.patterns = [self._sequences(t) for t in multi]

    @staticmethod
    def _sequences(table: dict[str, int]) -> re.Pattern:
        """Character sequences that a table shows for the bytes of one UTF-8 character; any byte after the first may be lost."""
        cls = lambda lo, hi, extra="": "[" + ("".join(re.escape(c) for c, b in table.items() if lo <= b <= hi) + extra or "\x00") + "]"
        more = cls(0x80, 0xBF, LOST)
        return re.compile(f"{cls(0xC2, 0xDF)}{more}|{cls(0xE0, 0xEF)}{more}{{2}}|{cls(0xF0, 0xF4)}{more}{{3}}|{cls(0xE0, 0xEF)}{more}{LOST}?(?={LOST})")

    def _plausible(self, char: str, k: int) -> bool:
        if k == 0:  # the best supported table is believed with new characters too; a control character may be half of a second misreading
            return unicodedata.category(char) not in ("Cn", "Cs", "Co")
        return char in self.known and unicodedata.category(char) != "Cc"

    def _weight(self, text: str) -> float:
        return sum(math.log(self.known.get(c, 0) + 0.5) for c in text)

    def _readings(self, text: str, k: int) -> tuple[str, bool, float]:
        """Text with all sequences of one table undone; whether any was garbled beyond recovery; how well known the result is."""
        lost, score, table = False, 0.0, self.multi[k]

        def one(m: re.Match) -> str:
            nonlocal lost, score
            try:
                char = bytes(table[c] for c in m[0]).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                if LOST in m[0]:
                    lost = True
                    return LOST
                return m[0]
            if not self._plausible(char, k):
                return m[0]
            score += self._weight(char) + 1e-6
            return char

        return self.patterns[k].sub(one, text), lost, score

    def undo_utf8(self, run: str) -> bool:
        """Whether some table reads a whole run as UTF-8."""
        for table in self.multi:
            try:
                if bytes(table[c] for c in run).decode("utf-8"):
                    return True
            except (KeyError, UnicodeDecodeError):
                pass
        return False

    def single_readings(self, run: str) -> Iterable[str]:
        """What a run is by each single-byte table that has all its characters."""
        for table in self.single:
            if all(c in table for c in run):
                yield "".join(table[c] for c in run)

    def _likelihood(self, run: str) -> float:
        return sum(math.log((self.pairs.get(run[i : i + 2], 0) + 0.01) / self.total) for i in range(len(run) - 1))

    def _single(self, text: str) -> str:
        best, gain = text, 0.0
        for table in self.single:
            better = 0.0
            decided: dict[str, str] = {}
            for run in set(RUN.findall(text)):
                other = "".join(table.get(c, LOST) for c in run)
                if LOST not in other and other != run and len(run) > 2:
                    g = self._likelihood(other) - self._likelihood(run)
                    if g > 1.5 * (len(run) - 1) and all(c in self.known for c in other):
                        better += g
                        decided[run] = other
            if better > gain and decided:
                for run in set(RUN.findall(text)) - set(decided):
                    other = "".join(table.get(c, LOST) for c in run)
                    if len(run) <= 2 and all(c in self.known for c in other):
                        decided[run] = other
                best, gain = RUN.sub(lambda m: decided.get(m[0], m[0]), text), better
        return best

    def repair(self, text: str) -> tuple[str, bool, bool]:
        """(restored text, garbled, whole): whole is false where characters are lost."""
        out, lost = text, False
        for _ in range(3):
            options = [self._readings(out, k) for k in range(len(self.multi))]
            options = [o for o in options if o[0] != out or o[1]]
            if not options:
                break
            new, gone, _score = max(options, key=lambda o: o[2])
            lost |= gone
            if new == out:
                break
            out = new
        if self.single:
            out = self._single(out)
        named = re.search(r"REPLACEMENT CHARACTER|U\+FFFD", text, re.I) is not None
        if LOST in out and not (named and LOST in text and not lost):
            lost = True
        return out, out != text or lost, not lost
