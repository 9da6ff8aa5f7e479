"""Typed names of persons and bodies, in plain Python for use inside Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

# Letters that decomposition leaves alone, by their plain form.
PLAIN = str.maketrans({"ø": "o", "đ": "d", "ð": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ı": "i", "’": "'", "‘": "'", "`": "'"})
# Titles before a person's name.
TITLES = set("dr prof professor doctor mr mrs ms miss mx sir dame rev hon herr frau mme mlle ing mag".split())
# Legal forms after a body's name.
FORMS = set("inc ltd limited incorporated gmbh llc llp corp corporation co company plc ag sa bv kg oy ab mbh gesellschaft".split())
SMALL = set("and of for the in on to de".split())


@lru_cache(maxsize=200_000)
def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.casefold().translate(PLAIN))
    return "".join(c for c in text if not unicodedata.combining(c)).translate(PLAIN)


def edits(a: str, b: str, most: int) -> int:
    """Additions, omissions, replacements and exchanges of neighbours between a and b; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    if most == 1 or len(a) == 1 and len(b) == 1:
        if len(a) == 1 and len(b) == 1 or (len(a) == 2 and len(b) == 2 and a == b[::-1]):
            return 1
        if most == 1:
            return 2
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:'[^\W_]+)*", text)


def squeeze(text: str) -> str:
    return re.sub(r"[\W_]+", "", text)


@dataclass
class Mention:
    """What a spelling says: possible (given, surname) readings, initials, nickname, affiliation."""

    readings: list[tuple[str, tuple[str, ...], str]] = field(default_factory=list)  # given or "", middle initials, squeezed surname
    nick: str = ""
    note: str = ""
    body: list[str] = field(default_factory=list)
    acronym: str = ""
    lone: str = ""
    tokens: list[str] = field(default_factory=list)
    order_free: str = ""


@lru_cache(maxsize=50_000)
def read_mention(text: str) -> Mention:
    m = Mention()
    text = re.sub(r"\s+", " ", text).strip()
    text = re.sub(r"(?i)\s+via\s+\S.*$", "", text)
    if note := re.search(r"\(([^()]*)\)?\s*$", text):
        if note.start() > 0:
            m.note, text = fold(note[1]).strip(), text[: note.start()].strip()
    if nick := re.search(r"[\"“”«»]([^\"“”«»]+)[\"“”«»]", text):
        if nick.start() > 0:
            m.nick, text = fold(nick[1]).strip(), (text[: nick.start()] + text[nick.end() :])
    text = text.strip(" \"“”'")
    if re.fullmatch(r"[A-Z]{2,6}", text):
        m.acronym = text
    plain = fold(text)
    m.body = body_words(plain)
    if "@" in plain:
        plain = plain.split("@")[0]
    if "," in plain:
        last, _, first = plain.partition(",")
        _person(m, words(first), words(last))
    elif " " not in plain.strip() and re.search(r"[._]", plain.strip(".")):
        parts = [p for p in re.split(r"[._]+", plain) if p]
        for k in range(1, len(parts)):
            _person(m, parts[:k], parts[k:])
            _person(m, parts[k:], parts[:k])
    else:
        parts = words(plain)
        titled = False
        while parts and parts[0] in TITLES and len(parts) > 1:
            parts, titled = parts[1:], True
        if len(parts) == 1 or (" " not in plain and "'" not in plain):
            m.lone = squeeze("".join(parts))
            if titled:
                m.readings.append(("", (), m.lone))
        else:
            if titled:
                m.readings.append(("", (), "".join(parts)))
            for k in range(1, len(parts)):
                _person(m, parts[:k], parts[k:])
                if k >= 1 and len(parts[-1]) > 1:
                    _person(m, parts[k:], parts[:k])
    m.tokens = words(plain)
    rest = [t for t in m.tokens if t not in TITLES]
    m.order_free = " ".join(sorted(rest)) if len(rest) > 1 else ""
    return m


def _person(m: Mention, given: list[str], surname: list[str]) -> None:
    given = [g for g in given if g not in TITLES]
    if not given or not surname:
        return
    head, middle = given[0], given[1:]
    if any(len(x) > 1 for x in middle):
        return  # several given names aren't expected
    # initials between given name and surname belong to neither
    while surname and len(surname[0]) == 1 and len(surname) > 1:
        middle, surname = [*middle, surname[0]], surname[1:]
    reading = (head, tuple(middle), "".join(squeeze(s) for s in surname))
    if reading not in m.readings:
        m.readings.append(reading)


def body_words(plain: str) -> list[str]:
    """Words of a body's name without legal form, article and small words."""
    out = [w for w in words(plain.replace("&", " and ").replace("'", "")) if w not in SMALL]
    while len(out) > 1 and out[-1] in FORMS:
        out.pop()
    return out


def abbreviates(short: str, word: str) -> bool:
    """Whether a shortened word keeps the first letter and the order of letters."""
    if not (2 <= len(short) < len(word)) or short[0] != word[0]:
        return False
    at = 0
    for c in short:
        at = word.find(c, at) + 1
        if not at:
            return False
    return True


@dataclass
class Profile:
    """A directory entry with what merged spellings have added: of nicknames, those that a mention in question holds."""

    contributor_id: int
    kind: str
    name: str
    note: str = ""
    given: str = ""
    surname: str = ""
    parts: list[str] = field(default_factory=list)
    body: list[str] = field(default_factory=list)
    acronyms: set[str] = field(default_factory=set)
    nicks: set[str] = field(default_factory=set)
    initials: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, contributor_id: int, kind: str, name: str, note: str | None) -> "Profile":
        p = cls(contributor_id, kind, name, fold(note or ""))
        plain = fold(name)
        if kind == "org":
            p.body = body_words(plain)
            every = [w for w in words(plain.replace("&", " and ")) if w not in FORMS]
            p.acronyms = {"".join(w[0] for w in ws).upper() for ws in (p.body, every, [w for w in every if w not in ("the", "and")])}
        else:
            parts = words(plain) or [plain]
            p.given, p.parts = parts[0], parts[1:]
            p.surname = "".join(squeeze(x) for x in p.parts)
        return p


def _given_cost(given: str, p: Profile) -> tuple[float, int] | None:
    """(cost, edits) of a typed given name; None if it is another one."""
    if given == p.given:
        return 0.0, 0
    if given in p.nicks:
        return 0.2, 0
    if len(given) == 1:
        return (1.0, 0) if given == p.given[0] else None
    n = len(p.given)
    e = edits(given, p.given, 2 if n >= 5 else 1 if n >= 4 else 0)
    return (float(e), e) if n >= 4 and e <= (2 if n >= 5 else 1) else None


def person_cost(m: Mention, p: Profile) -> float | None:
    """How far a mention is from a person; None if it can't be that person."""
    best = None
    n = len(p.surname)
    most = 2 if n >= 6 else 1 if n >= 4 else 0
    for given, middle, surname in m.readings:
        s = edits(surname, p.surname, most)
        if s > most:
            continue
        if given:
            g = _given_cost(given, p)
            if g is None or s + g[1] > 2:
                continue
            if len(given) == 1 and s > 1:
                continue
            cost = s + g[0]
            if m.nick and m.nick not in p.nicks and g[0] >= 1:
                cost += 0.5
        else:
            if s > 1:
                continue
            cost = s + 1.5
        if middle and p.initials:
            cost += -0.1 if middle[0] in p.initials else 0.1
        if m.note and p.note:
            cost += -0.3 if m.note == p.note else 0.0
        best = cost if best is None else min(best, cost)
    if best is None and m.lone:
        for g in {p.given, *p.nicks}:
            # a letter may be wrong where the whole name is there; with an initial only, it could be another name
            for handle, c, most_ in ((p.given[0] + p.surname, 1.0, 0), (p.surname + p.given[0], 1.0, 0), (g + p.surname, 0.0, 1), (p.surname + g, 0.0, 1)):
                e = edits(m.lone, handle, most_)
                if e <= most_:
                    best = c + e if best is None else min(best, c + e)
    return best


def body_cost(m: Mention, p: Profile) -> float | None:
    """How far a mention is from a body; None if it can't be that body."""
    if m.acronym:
        return 1.0 if m.acronym in p.acronyms else None
    a, b = m.body, p.body
    if not a:
        return None
    if a == b:
        return 0.0
    if len(a) == 1 and len(b) > 1:
        e = edits(a[0], b[0], 1)
        return 1.0 + e if len(b[0]) >= 5 and e <= 1 else None
    whole = edits("".join(a), "".join(b), 3)
    best = float(whole) if whole <= (3 if len("".join(b)) > 24 else 2) else None
    # word by word, with abbreviations; several words may share one token of initials
    i = j = short = wrong = 0
    while i < len(a) and j < len(b):
        e = edits(a[i], b[j], 2 if len(b[j]) >= 6 else 1)
        if e <= (2 if len(b[j]) >= 6 else 1 if len(b[j]) >= 4 else 0):
            wrong += e
            i, j = i + 1, j + 1
        elif 2 <= len(a[i]) <= len(b) - j and all(c == w[0] for c, w in zip(a[i], b[j:])):
            short += 1
            i, j = i + 1, j + len(a[i])
        elif abbreviates(a[i], b[j]):
            short += 1
            i, j = i + 1, j + 1
        else:
            return best
    if i == len(a) and j == len(b) and wrong <= 2 and short <= 2 and short < len(a):
        cost = wrong + 0.5 * short
        best = cost if best is None else min(best, cost)
    return best


def deletions(word: str) -> set[str]:
    """A word and what is left of it without one letter: words one edit apart share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) > 3 else {word}


def mention_keys(m: Mention) -> set[str]:
    """Blocking keys of a mention: words with up to one letter left out, nicknames, initials with surname, acronyms, whole handles."""
    if m.acronym:
        keys = {"a:" + m.acronym}
    else:
        keys = {"g:" + t for t in m.tokens} | {"d:" + d for t in m.tokens for d in deletions(squeeze(t))}
        keys |= {"d:" + d for _, _, surname in m.readings for d in deletions(surname)}
        keys |= {f"m:{middle[0]}:{surname}" for _, middle, surname in m.readings if middle}
    if m.nick:
        keys.add("g:" + m.nick)
    if m.lone:
        keys |= {"h:" + d for d in deletions(m.lone)}
    return keys


def profile_keys(p: Profile) -> set[str]:
    """Blocking keys of a directory entry by itself."""
    if p.kind == "org":
        keys = {"d:" + d for w in p.body for d in deletions(w)} | {"a:" + a for a in p.acronyms}
        return keys | {"d:" + "".join(w[0] for w in p.body)}
    keys = {"d:" + d for w in (*p.parts, p.surname) for d in deletions(squeeze(w))} | {"g:" + p.given}
    handles = (p.given[:1] + p.surname, p.surname + p.given[:1], p.given + p.surname, p.surname + p.given)
    return keys | {"h:" + d for h in handles for d in deletions(h)}


def gained_keys(p: Profile, nick: str | None, initial: str | None) -> set[str]:
    """Blocking keys that a profile gains with a nickname or an initial."""
    keys = set()
    if nick:
        keys |= {"g:" + nick} | {"h:" + d for h in (nick + p.surname, p.surname + nick) for d in deletions(squeeze(h))}
    if initial:
        keys.add(f"m:{initial}:{p.surname}")
    return keys


def choose(m: Mention, profiles: list[Profile], hint: str | None) -> tuple[int, float] | None:
    """(contributor_id, cost) of the one profile that fits best; None if none or several do."""
    scored = []
    for p in profiles:
        cost = body_cost(m, p) if p.kind == "org" else person_cost(m, p)
        if cost is not None:
            scored.append((cost, p.contributor_id))
    if not scored:
        return None
    scored.sort()
    if len(scored) == 1 or scored[1][0] - scored[0][0] > 0.05:
        # an initial or a bare surname doesn't tell namesakes apart, even if one of them is spelled better
        return scored[0][1], scored[0][0]
    if hint:
        by_id = {p.contributor_id: p for p in profiles}
        tied = [c for cost, c in scored if cost - scored[0][0] <= 0.05]
        other = read_mention(hint)
        second = sorted((x, c) for c in tied if (x := person_cost(other, by_id[c]) if by_id[c].kind != "org" else None) is not None)
        if second and (len(second) == 1 or second[1][0] - second[0][0] > 0.5) and second[0][0] < 1:
            return second[0][1], scored[0][0]
    return None


#: Letters from which a whole name is long enough to be recognised with one of them wrong.
LONG_NAME = 10


def full_form(m: Mention) -> str:
    """The words of a full name in any order, or '': no initials and no lone word, which fit several persons."""
    rest = [t for t in m.tokens if t not in TITLES]
    return " ".join(sorted(rest)) if len(rest) > 1 and all(len(t) > 2 for t in rest) else ""


def form_keys(form: str) -> set[str]:
    """Two forms that differ by one letter share a key; at most length x alphabet forms share one."""
    return deletions(squeeze(form)) if len(squeeze(form)) >= LONG_NAME else {squeeze(form)}


def same_form(a: str, b: str) -> bool:
    a, b = squeeze(a), squeeze(b)
    return a == b or min(len(a), len(b)) >= LONG_NAME and edits(a, b, 1) <= 1


def told_nickname(text: str, local: str) -> list[tuple[str, str, str]]:
    """(given name, nickname, surname) where an address's local part has another given name before or after the same surname.

    A local part may be cut off after at least five letters of the surname.
    """
    found = []
    for nick, _, surname in read_mention(text).readings:
        for given, _, other in read_mention(local).readings:
            if len(nick) < 2 or len(given) < 3 or edits(nick, given, 2) <= 2 and nick[0] == given[0] and len(nick) > 4:
                continue
            if nick != given and (other == surname or len(other) >= 5 and surname.startswith(other)):
                found.append((given, nick, surname))
    return found
