"""Variant spellings of typed names of persons and groups.

Typed names are cut into tokens; a symmetric-delete index over all tokens (family names, given names, words of groups)
finds tokens a small edit apart. Names whose family names are equal or such an edit apart meet in a block; there,
candidates come from a delete index over given names, and all given tokens of two candidates are aligned by optimal
assignment, which permits initials, abbreviations and short forms. Groups meet under pairs of their rarer words and are
aligned the same way. Ids that carry names of one person or group are linked.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholark.operators.graph.components import CLASS_BLOCK, connected_components
from scholark.session import cut_lineage

# Letters without a decomposition, titles, particles, and what makes a name a group's.
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h", "ŋ": "n"})
TITLES = frozenset("dr prof professor phd msc bsc mr mrs mx jr sr iii esq dphil mphil habil".split())
PARTICLES = frozenset("von van der den de del della di da dos das du la le al el bin ibn ben ter ten zu zur v d y".split())
GROUP_WORDS = {"consortium": "consortium", "cons": "consortium", "collaboration": "collaboration", "collab": "collaboration", "coll": "collaboration", "network": "network", "netw": "network", "net": "network", "group": "group", "grp": "group", "team": "team", "initiative": "initiative", "alliance": "alliance", "committee": "committee", "society": "society", "project": "project", "force": "force", "tf": "task force", "wg": "working group", "sg": "study group", "organisers": "organisers", "organizers": "organisers", "organisation": "organisers", "organization": "organisers", "org": "organisers", "working": "working", "task": "task", "study": "study"}
#: Words that alone make a name a group's, the others only beside them.
GROUP_MARKS = frozenset("organisers organizers organisation organization org consortium cons collaboration collab network group grp initiative alliance committee society force tf wg sg".split())
SMALL_WORDS = frozenset("the for of and on in to a an".split())
#: Family names for which two given names must have been typed for one id each to count as forms of one name.
ALIAS_FAMILIES = 3
#: Given names and words of groups shorter than this get no edits. A family name no longer than this counts as another an
#: edit apart only where two or more given tokens are the same.
SHORT = 4
#: Weight of an initial beside a written token; least fit of two persons' given tokens; of given tokens in another order;
#: of a group's words.
INITIAL_WEIGHT, SAME_GIVEN, REORDERED, SAME_GROUP = 0.25, 0.75, 0.9, 0.85
#: Initials of a list from which they alone may make it agree by REORDERED with another.
MOSTLY_INITIALS = 8

_LEET = str.maketrans({"0": "o", "1": "l", "3": "e", "5": "s"})
_BRACKETS = regex.compile(r"\([^()]*\)?|\[[^\[\]]*\]?")
_HIDDEN = regex.compile(r"[\p{Cf}\p{Cc}]")
_SPACE = regex.compile(r"[\s ]+")


def fold(text: str) -> str:
    """Lower case without marks; letters that have no plain base letter are spelled out."""
    if text.isascii():
        return text.lower()
    plain = unicodedata.normalize("NFKD", text.lower().translate(LETTERS))
    return "".join(c for c in plain if not unicodedata.combining(c))


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours (or none) turns ``a`` into ``b``."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


def _plain_tokens(part: str) -> list[tuple[str, str]] | None:
    """``_tokens`` of a part of nothing but usual words and dotted initials; None where more care is needed."""
    found = []
    for piece in part.split():
        body = piece[:-1] if piece[-1] == "." else piece
        if not body.isalpha():
            return None
        if len(body) == 1:
            found.append((fold(body), "initial"))
            continue
        rest = body[1:]
        if len(body) < 4 and (piece != body or body.isupper()) or not (rest.islower() or body.isupper()):
            return None
        plain = fold(body)
        if plain in TITLES or plain in PARTICLES:
            return None
        found.append((plain.replace("rn", "m"), "short" if piece != body and len(plain) <= 5 else "word"))
    return found


def _tokens(part: str) -> list[tuple[str, str]]:
    """(token, kind) of a typed part: ``initial``, ``short`` (dotted abbreviation), ``particle`` or ``word``."""
    if (plain := _plain_tokens(part)) is not None:
        return plain
    part = regex.sub(r"(?<=[\p{L}])\d+(?=\W|$)", "", part)
    part = regex.sub(r"(?i)\bv\.\s*d\.", "von der ", part)
    mixed = bool(regex.search(r"\p{Ll}", part))
    found = []
    pieces = regex.findall(r"[\p{L}\p{N}'’`´\-‐]+\.?", part)
    for at, raw in enumerate(pieces):
        dotted, body = raw.endswith("."), raw.rstrip(".").strip("-‐'’`´")
        if not regex.search(r"\p{L}", body):
            continue
        if tail := regex.match(r"(\p{Lu}?\p{Ll}{2,})(\p{Lu}{1,2})$", body):
            found += [(fold(tail[1]), "word"), *[(fold(c), "initial") for c in tail[2]]]
            continue
        plain = fold(body).replace("'", "").replace("’", "").replace("`", "").replace("´", "").replace("‐", "-")
        if regex.search(r"[0135]", plain):
            plain = plain.translate(_LEET)
        if plain.replace(".", "") in TITLES and len(plain) > 1:
            continue
        plain = plain.replace("rn", "m")  # a common misreading
        led, last = bool(found) and found[-1] == ("von", "particle"), at == len(pieces) - 1
        if len(plain) == 1:
            found.append((plain, "initial"))
        elif body.isupper() and (mixed and len(body) <= 3 and (last or plain not in PARTICLES) or last and plain in PARTICLES):
            found += [(c, "initial") for c in plain]
        elif led and not last and len(plain) <= 4 and one_edit(plain, "der"):
            found.append(("der", "particle"))
        elif not last and len(plain) <= 4 and one_edit(plain, "von") and fold(pieces[at + 1]) == "der":
            found.append(("von", "particle"))
        elif plain in PARTICLES and len(plain) > 1:
            found.append((plain, "particle"))
        else:
            for prefix in ("al-", "el-"):
                if plain.startswith(prefix):
                    plain = plain[len(prefix) :]
                    found.append((prefix[:-1], "particle"))
            found.append((plain, "short" if dotted and len(plain) <= 5 else "word"))
    return found


def parse_name(raw: str) -> dict | None:
    """The parts of a typed name; None where it holds no name.

    ``kind`` is ``group`` (``words``), ``person`` (``family``: words of the family name, ``given``: all given tokens, an
    initial being one letter and a dotted abbreviation ending in a dot) or, where word order leaves open which part is
    the family name, ``open`` (``words``).
    """
    if raw is None:
        return None
    text = _SPACE.sub(" ", _HIDDEN.sub("", raw)).replace("*", " ").strip(" ,;.†‡")
    words = [fold(w) for w in regex.findall(r"\p{L}+", text)] if text.count(" ") > 1 or "-" in text else []
    if len(words) >= 3 and not GROUP_MARKS.isdisjoint(words):
        kept = [GROUP_WORDS.get(w, w) for w in words if w not in SMALL_WORDS]
        return {"kind": "group", "words": [x for w in kept for x in w.split()]}
    if "(" in text or "[" in text:
        text = _BRACKETS.sub(" ", text)
    if "," in text:
        text = regex.sub(r"(?i),\s*(?:ph\.?\s?d|m\.?\s?sc|b\.?\s?sc|m\.?\s?d|m\.?\s?a|b\.?\s?a|jr|sr)\.?\s*$", "", text).strip(" ,;")
    if text[:2].lower() in ("dr", "pr"):
        text = regex.sub(r"(?i)^(?:(?:prof|dr|professor)\b\.?\s*)+", "", text)
    if "," in text:
        before, after = text.split(",", 1)
        family, given = _tokens(before), _tokens(after)
        last = [t for t, k in family if k in ("word", "short")]
        if last and given:
            return _person(last, [(t, k) for t, k in given if k != "particle"])
        text = text.replace(",", " ")
    parts = _tokens(text)
    # A particle belongs to the word after it, and with it to the family name.
    joined: list[tuple[str, str]] = []
    led = False
    for token, kind in parts:
        if kind == "particle":
            led = True
        else:
            joined.append((token, "led" if led and kind in ("word", "short") else kind))
            led = False
    long = [(i, t, k) for i, (t, k) in enumerate(joined) if k != "initial"]
    if not long:
        return None
    rest = lambda taken: [(t, k) for i, (t, k) in enumerate(joined) if i not in taken]
    if any(k == "led" for _, _, k in long):
        taken = {i for i, _, k in long if k == "led"}
        return _person([t for i, t, _ in long if i in taken], rest(taken))
    if len(long) == 1:
        return _person([long[0][1]], rest({long[0][0]}))
    hyphened = {i for i, t, _ in long if "-" in t}
    if len(hyphened) == 1:
        return _person([t for i, t, _ in long if i in hyphened], rest(hyphened))
    dotted = {i for i, _, k in long if k == "short"}
    if dotted and len(dotted) < len(long):
        taken = {i for i, _, _ in long} - dotted
        return _person([t for i, t, _ in long if i in taken], rest(taken))
    if joined[0][1] != "initial" and joined[-1][1] != "initial" and any(k == "initial" for _, k in joined):
        cut = max(i for i, (_, k) in enumerate(joined) if k == "initial")
        taken = {i for i, _, _ in long if i > cut}
        return _person([t for i, t, _ in long if i in taken], rest(taken))
    if joined[0][1] == "initial":
        return _person([long[-1][1]], rest({long[-1][0]}))
    return {"kind": "open", "words": [t for t, _ in joined]}


def _person(family: list[str], given: list[tuple[str, str]]) -> dict | None:
    words = [p for t in family for p in t.split("-") if p]
    tokens = [t + "." if k == "short" else t for t, k in given if t]
    return {"kind": "person", "family": words, "given": tokens} if words and tokens else None


def oriented(words: list[str], lean: list[float]) -> dict | None:
    """The person behind an open name; ``lean`` says how much more often each word is a given than a family name."""
    if len(words) < 2:
        return None
    if lean[0] - lean[-1] + 0.5 >= 0:
        cut = len(words) - 1
        while cut > 1 and lean[cut - 1] < -0.5:
            cut -= 1
        family, given = words[cut:], words[:cut]
    else:
        cut = 1
        while cut < len(words) - 1 and lean[cut] < -0.5:
            cut += 1
        family, given = words[:cut], words[cut:]
    return _person(family, [(t, "word" if len(t) > 1 else "initial") for t in given])


def token_fit(a: str, b: str, forms: dict[str, set[str]]) -> float:
    """How well two tokens fit, from 0 to 1: equal, a short form, an edit, an abbreviation, an initial."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        one, other = (a, b) if len(a) == 1 else (b, a)
        return 0.5 if any(f[0] == one for f in {other, *forms.get(other, ())}) else 0.0
    if b in forms.get(a, ()) or a in forms.get(b, ()) or forms.get(a, set()) & forms.get(b, set()):
        return 0.95
    if min(len(a), len(b)) >= SHORT and one_edit(a, b):
        return 0.9
    short, long = sorted((a, b), key=len)
    return 0.7 if len(short) >= 3 and long.startswith(short) else 0.0


def assignment(gains: list[list[float]]) -> float:
    """The largest sum of one gain a row, no column taken twice; there are no more rows than columns.

    Rows are assigned one after another along shortest augmenting paths (the Hungarian method), so lists of any length
    are read whole, in cubic time.
    """
    n, m = len(gains), len(gains[0]) if gains else 0
    row_price, column_price, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, came, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[at]:
            done[at], row, step, nearest = True, owner[at], float("inf"), 0
            for j in range(1, m + 1):
                if not done[j]:
                    cost = -gains[row - 1][j - 1] - row_price[row] - column_price[j]
                    if cost < least[j]:
                        least[j], came[j] = cost, at
                    if least[j] < step:
                        step, nearest = least[j], j
            for j in range(m + 1):
                if done[j]:
                    row_price[owner[j]] += step
                    column_price[j] -= step
                else:
                    least[j] -= step
            at = nearest
        while at:
            owner[at] = owner[came[at]]
            at = came[at]
    return sum(gains[owner[j] - 1][j - 1] for j in range(1, m + 1) if owner[j])


def align(a: list[str], b: list[str], forms: dict[str, set[str]]) -> float:
    """Mean fit of the best assignment of the shorter list's tokens to different tokens of the longer, all tokens read."""
    short, long = sorted((a, b), key=len)
    return assignment([[token_fit(x, y, forms) for y in long] for x in short]) / len(short) if short else 0.0


def given_fit(a: list[str], b: list[str], forms: dict[str, set[str]]) -> float:
    """``align`` of given names: an initial weighs INITIAL_WEIGHT and fits fully where its letter agrees."""
    weight = lambda t: 1.0 if len(t) > 1 else INITIAL_WEIGHT
    short, long = sorted((a, b), key=lambda g: (len(g), sum(map(weight, g))))
    if not short:
        return 0.0
    if len(short) == 1 and len(long) == 1 or short == long:
        return _given_token(short[0], long[0], forms) if short != long else 1.0
    gains = [[weight(x) * _given_token(x, y, forms) for y in long] for x in short]
    return assignment(gains) / sum(map(weight, short))


def _given_token(x: str, y: str, forms: dict[str, set[str]]) -> float:
    if x == y:
        return 1.0
    if x[-1] == "." or y[-1] == ".":
        x, y = sorted((x.rstrip("."), y.rstrip(".")), key=len)
        return 1.0 if y.startswith(x) else token_fit(x, y, forms)
    fit = token_fit(x, y, forms)
    return 1.0 if fit == 0.5 else fit


def one_person(a: list[str], b: list[str], forms: dict[str, set[str]]) -> bool:
    """Whether two lists of given tokens, both led by a written name, are one person's within a family name."""
    if a == b:
        return True
    if token_fit(a[0], b[0], forms) >= REORDERED:
        return len(a) == 1 or len(b) == 1 or given_fit(a, b, forms) >= SAME_GIVEN
    return len(a) == len(b) > 1 and given_fit(a, b, forms) >= REORDERED


def deletes(token: str) -> list[str]:
    """A token and what it becomes with one letter deleted; the token alone where it is too short for edits."""
    return [token, *{token[:i] + token[i + 1 :] for i in range(len(token))}] if len(token) >= SHORT else [token]


class _Sets:
    """Disjoint sets of list places, the smaller place being a set's name."""

    def __init__(self, n: int) -> None:
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = sorted((self.find(i), self.find(j)))
        self.root[j] = i


def _near_keys(token: str, forms: dict[str, set[str]]) -> set[str]:
    """What two tokens share that are equal, an edit or a short form apart."""
    plain = token.rstrip(".")
    return {*deletes(plain), *(f"~{f}" for f in (plain, *forms.get(plain, ())))}


def persons_of_names(fulls: list[list[str]], forms: dict[str, set[str]]) -> list[int]:
    """For each list of given tokens led by a written name the place of its person's first list.

    Lists whose leading names fit all meet, until they are one person's: leading names are compared where they share a key of
    the delete index or a short form. Lists in another order must agree by REORDERED, so they share a written token, an edit,
    a short form or an abbreviation apart, by whose keys they meet, unless they are mostly initials.
    """
    sets, heads = _Sets(len(fulls)), {}
    for i, g in enumerate(fulls):
        heads.setdefault(g[0], []).append(i)

    def meet(i: int, j: int) -> None:
        if sets.find(i) != sets.find(j) and one_person(fulls[min(i, j)], fulls[max(i, j)], forms):
            sets.union(i, j)

    def meet_all(one: list[int], other: list[int]) -> None:
        for i in one:
            if len({sets.find(j) for j in (*one, *other)}) == 1:
                return
            for j in other:
                meet(i, j)

    for places in heads.values():
        # A leading name alone, or beside one initial, fits all lists that it leads.
        plain = next((i for i in places if len(fulls[i]) == 1 or len(fulls[i]) == 2 and len(fulls[i][1]) == 1), None)
        if plain is not None:
            for i in places:
                sets.union(plain, i)
        elif len(places) > 1:
            meet_all(places, places)
    if len(heads) > 1:
        near: dict[str, list[str]] = {}
        pairs = set()
        for h in heads:
            for key in _near_keys(h, forms):
                pairs.update((o, h) for o in near.get(key, ()) if o != h)
                near.setdefault(key, []).append(h)
        for a, b in pairs:
            if token_fit(a, b, forms) >= REORDERED:
                meet_all(heads[a], heads[b])
        turned: dict[tuple[int, str], list[int]] = {}
        longer = [i for i, g in enumerate(fulls) if len(g) > 1]
        for i in longer:
            for t in fulls[i]:
                if len(t) > 1:
                    for key in (*_near_keys(t, forms), *(f"^{t[:n]}" for n in range(1, len(t.rstrip(".")) + 1))):
                        turned.setdefault((len(fulls[i]), key), []).append(i)
        for i in longer:
            g = fulls[i]
            asked = {key for t in g if len(t) > 1 for key in (*_near_keys(t, forms), *([f"^{t[:-1]}"] if t[-1] == "." else []))}
            met = {j for key in asked for j in turned.get((len(g), key), ())}
            if sum(len(t) == 1 for t in g) >= MOSTLY_INITIALS:
                met.update(j for j in longer if len(fulls[j]) == len(g))
            for j in met:
                if j != i:
                    meet(i, j)
    return [sets.find(i) for i in range(len(fulls))]


def label_persons(rows: list[str], forms: dict[str, set[str]]) -> list[str | None]:
    """A label for each list of given tokens (words of a string) typed with one family name; None where several persons
    would fit.

    Full names that align are one person's. Abbreviations and initials go to the only person with whom they align,
    their further tokens deciding where needed; those that fit nobody form persons of their own.
    """
    lists = [r.split(" ") for r in rows]
    kinds = ["initial" if len(g[0]) == 1 else "short" if g[0][-1] == "." else "full" for g in lists]
    known = sorted({r for r, k in zip(rows, kinds) if k == "full"})
    fulls = [r.split(" ") for r in known]
    place = dict(zip(known, persons_of_names(fulls, forms))) if len(fulls) > 1 else dict.fromkeys(known, 0)
    label = {r: known[i] for r, i in place.items()}
    # What initials and abbreviations are read by: a person's leading names and further letters, by first letter.
    heads: dict[str, set[str]] = {}
    letters: dict[str, set[str]] = {}
    for r, g in zip(known, fulls):
        heads.setdefault(label[r], set()).add(g[0])
        letters.setdefault(label[r], set()).update(t[0] for t in g[1:2])
    begun: dict[str, set[str]] = {}
    for person, names in heads.items():
        for n in names:
            for f in (n, *forms.get(n, ())):
                begun.setdefault(f[0], set()).add(person)

    def place_of(g: list[str], fits: list[str]) -> str | None:
        if len(g) > 1:
            fits = [p for p in fits if not letters[p] or g[1][0] in letters[p]]
            exact = [p for p in fits if g[1][0] in letters[p]]
            fits = exact or fits
        if len(fits) == 1:
            return fits[0]
        return None if fits else f"{g[0].rstrip('.')}|{g[1][0] if len(g) > 1 else ''}"

    for r in sorted({r for r, k in zip(rows, kinds) if k == "short"}):
        g = r.split(" ")
        head = g[0][:-1]
        near = begun.get(head[0], set()) | (begun.get(head[1], set()) if len(head) > 1 else set())
        fits = sorted(p for p in near if any(n.startswith(head) or token_fit(head, n, forms) >= REORDERED for n in heads[p]))
        label[r] = place_of(g, fits)
        if label[r] is not None and label[r] not in heads:
            heads[label[r]], letters[label[r]] = {head}, {t[0] for t in g[1:2]}
            begun.setdefault(head[0], set()).add(label[r])
    own: dict[str, list[str]] = {}
    for r in sorted({r for r, k in zip(rows, kinds) if k == "initial"}, key=lambda r: (" " not in r, r)):
        g = r.split(" ")
        found = place_of(g, sorted(begun.get(g[0], ())))
        if found is not None and found not in heads:
            if len(g) > 1:
                own.setdefault(g[0], []).append(found)
            else:
                mates = own.get(g[0], [])
                found = mates[0] if len(set(mates)) == 1 else None if mates else found
        label[r] = found
    return [label[r] for r in rows]


_NAMES = "id {id}, kind string, name string"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``name`` of a person: family name, a bar and given tokens; of others the words."""
    for batch in batches:
        rows = []
        for i, raw in zip(batch["id"], batch["raw"]):
            if (p := parse_name(raw)) is not None:
                rows.append((i, p["kind"], _written(p) if p["kind"] == "person" else " ".join(p["words"])))
        yield pd.DataFrame(rows, columns=["id", "kind", "name"])


def _written(person: dict) -> str:
    return " ".join(person["family"]) + "|" + " ".join(person["given"])


def _orient(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [(i, _written(p)) for i, words, lean in zip(batch["id"], batch["words"], batch["lean"]) if (p := oriented(list(words), list(lean))) is not None]
        yield pd.DataFrame(found, columns=["id", "name"])


def near_pairs(tokens: DataFrame, least: int = SHORT) -> DataFrame:
    """``token``, ``other``: every two tokens of ``least`` letters or more one edit apart, in both orders.

    ``tokens`` has ``token`` (repeated ones count once). The index is that of symmetric deletes: two tokens are compared
    only where both, or one with a letter deleted, give the same string; all such meetings are compared exactly. Under
    one key are only the different tokens one letter longer than it, at most the alphabet times its length, so a key's
    list is bounded whatever the number of rows.
    """
    long = tokens.where(F.length("token") >= least).select("token").distinct()
    cut = F.array_distinct(F.concat(F.array("token"), F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.concat(F.substring("token", F.lit(1), i - 1), F.substring("token", i + 1, F.length("token"))))))
    keyed = long.select("token", F.explode(F.transform(cut, lambda k: F.xxhash64(k))).alias("key"))
    lists = keyed.groupBy("key").agg(F.collect_list("token").alias("ts")).where(F.size("ts") > 1)
    met = lists.select(F.explode("ts").alias("token"), "ts").select("token", F.explode("ts").alias("other")).where("token < other")
    swapped = F.exists(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.col("other") == F.concat(F.substring("token", F.lit(1), i - 1), F.substring("token", i + 1, F.lit(1)), F.substring("token", i, F.lit(1)), F.substring("token", i + 2, F.length("token"))))
    close = met.withColumn("far", F.levenshtein("token", "other", 2)).where((F.col("far") == 1) | ((F.col("far") == 2) & (F.length("token") == F.length("other")) & swapped))
    both = F.array(F.struct("token", "other"), F.struct(F.col("other").alias("token"), F.col("token").alias("other")))
    return close.select(F.explode(both).alias("p")).select("p.token", "p.other").distinct()


def _label_blocks(forms: dict[str, set[str]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Labels the sorted rows of blocks (``block``, ``given``, ``fam``, ``also``); a block cut by a batch's end waits for the next."""

    def block_rows(key: str, rows: list[tuple]) -> list[tuple]:
        known = forms
        if any(r[3] is not None for r in rows):
            known = forms | {h: forms.get(h, set()) | set(r[3]) for r in rows if r[3] is not None and (h := r[1].split(" ", 1)[0])}
        fam = key[: key.index("\u0001")]
        labels = label_persons([r[1] for r in rows], known)
        written = [len(h) > 1 and h[-1] != "." for h in (r[1].split(" ", 1)[0] for r in rows)]
        named = {x for x, w in zip(labels, written) if w}
        own = {r[1] for r in rows if r[2] == fam}
        kept: list[tuple] = []
        for r, x, w in zip(rows, labels, written):
            # A short given name is read by its own family name, where all its neighbours are; elsewhere it joins only its like.
            far = r[2] != fam
            if x is None and not far:
                kept.append((r[2] + "|" + r[1], None, True))
            elif x is None or far and (not w and x in named or min(len(fam), len(r[2])) <= SHORT and (" " not in r[1] or r[1] not in own)):
                continue
            else:
                kept.append((r[2] + "|" + r[1], x, not far))
        count = Counter(x for _, x, _ in kept)
        return [(f, None if x is None else f"{key}|{x}" if count[x] > 1 else f) for f, x, mine in kept if mine or count[x] > 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[tuple] = []
        for batch in batches:
            rows = rest + list(batch[["block", "given", "fam", "also"]].itertuples(index=False, name=None))
            last = next((i for i in range(len(rows) - 1, -1, -1) if rows[i][0] != rows[-1][0]), -1) + 1 if rows else 0
            yield pd.DataFrame(labelled(rows[:last]), columns=["name", "who"])
            rest = rows[last:]
        yield pd.DataFrame(labelled(rest), columns=["name", "who"])

    def labelled(rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        begin, n = 0, len(rows)
        while begin < n:
            key, end = rows[begin][0], begin + 1
            while end < n and rows[end][0] == key:
                end += 1
            if end - begin == 1:  # alone in its block: a name of its own family stands for itself
                _, given, fam, _ = rows[begin]
                if key.startswith(fam + "\u0001"):
                    out.append((name := f"{fam}|{given}", name))
            else:
                out += block_rows(key, rows[begin:end])
            begin = end
        return out

    return run


def link_persons(persons: DataFrame, forms: dict[str, set[str]]) -> DataFrame:
    """``name``, ``who``: what each written name (``name`` of ``persons``, which also has ``id``) stands for, null where that
    may be several persons.

    A block is a family name and a letter with which a given name may begin. A name goes to the blocks of its own family
    name and of those an edit apart, under the first letters of its written given names, of their short forms and of given
    names an edit apart; so every two names that can align meet, and however many rows or names a family name has, a
    task holds only its different given names of one letter.
    """
    parts = F.split("name", "\\|")
    written = cut_lineage(persons.select("name").distinct().select(parts[0].alias("fam"), parts[1].alias("given")).withColumn("head", F.split("given", " ")[0]))
    full = (F.length("head") > 1) & ~F.endswith("head", F.lit("."))
    tokens = written.select(F.explode(F.array(F.concat(F.lit("f"), "fam"), F.when(full & (F.length("head") >= SHORT), F.concat(F.lit("g"), "head")))).alias("token")).where("token is not null")
    near = cut_lineage(near_pairs(tokens, 2).where(F.substring("token", 1, 1) == F.substring("other", 1, 1)))
    families = near.where("token like 'f%'").select(F.expr("substring(token, 2)").alias("fam"), F.expr("substring(other, 2)").alias("key"))

    # Short forms that the table lacks: given names typed for one id under one family name, for several families. Each
    # name is paired with the one that the id has most, so an id with very many names costs no more than its rows.
    called = persons.select("id", parts[0].alias("fam"), F.split(parts[1], " ")[0].alias("head")).where(full).groupBy("id", "fam", "head").agg(F.count(F.lit(1)).alias("n"))
    several = called.groupBy("id").agg(F.max(F.struct("n", "head", "fam")).alias("top"), F.min("head").alias("a"), F.max("head").alias("b")).where("a <> b").select("id", "top.head", "top.fam")
    pairs = called.join(several.withColumnsRenamed({"head": "other", "fam": "top_fam"}), "id").where("head <> other and levenshtein(fam, top_fam, 2) >= 0").select("top_fam", F.explode(F.array(F.struct("head", "other"), F.struct(F.col("other").alias("head"), F.col("head").alias("other")))).alias("p")).select("top_fam", "p.head", "p.other").distinct()
    smallest = families.groupBy("fam").agg(F.min("key").alias("key")).select(F.col("fam").alias("top_fam"), F.least("fam", "key").alias("least_fam"))
    learned = pairs.join(smallest, "top_fam", "left").groupBy("head", "other").agg(F.countDistinct(F.coalesce("least_fam", "top_fam")).alias("n")).where(F.col("n") >= ALIAS_FAMILIES)

    letter = F.substring("other", 1, 1).alias("letter")
    listed = persons.sparkSession.createDataFrame([(a, b) for a, bs in forms.items() for b in bs], "head string, other string")
    also = learned.select("head", "other", letter)
    both = listed.unionByName(listed.select(F.col("other").alias("head"), F.col("head").alias("other")))
    edits = near.where("token like 'g%' and substring(token, 2, 1) <> substring(other, 2, 1)").select(F.expr("substring(token, 2)").alias("head"), F.lit(None).cast("string").alias("other"), F.expr("substring(other, 2, 1)").alias("letter"))
    hints = also.unionByName(both.select("head", F.lit(None).cast("string").alias("other"), letter)).unionByName(edits)
    hints = hints.groupBy("head").agg(F.collect_set("other").alias("also"), F.collect_set("letter").alias("letters"))

    hinted = written.select("fam", "given", "head").join(hints, "head", "left")
    also_known = F.when(F.size("also") > 0, F.col("also"))
    own_letters = F.transform(F.filter(F.split("given", " "), lambda t: F.length(t) > 1), lambda t: F.substring(t, 1, 1))
    letters = F.array_distinct(F.when(full, F.concat(own_letters, F.coalesce("letters", F.array().cast("array<string>")))).otherwise(F.array(F.substring("head", 1, 1))))
    lettered = hinted.select("fam", "given", also_known.alias("also"), F.explode(letters).alias("letter"))
    keys = families.groupBy("fam").agg(F.collect_set("key").alias("keys"))  # its near names are bounded as in near_pairs
    spread = lettered.join(keys, "fam", "left").select("fam", "given", "also", "letter", F.explode(F.concat(F.array("fam"), F.coalesce("keys", F.array().cast("array<string>")))).alias("key"))
    blocks = spread.select(F.concat_ws("\u0001", "key", "letter").alias("block"), "given", "fam", "also").repartition("block").sortWithinPartitions("block", "given", "fam")
    return blocks.mapInPandas(_label_blocks(forms), "name string, who string")


def group_pairs(groups: DataFrame, forms: dict[str, set[str]]) -> DataFrame:
    """``name``, ``other``: names of groups (``name``: words) whose words align to SAME_GROUP, their lengths one apart at most.

    Two such names of ``n`` words and more agree in at least half of the ``n`` words up to an edit, so they share a pair of
    such words among each one's ``n // 2 + 2`` rarest (one word, where ``n`` is under 3): names meet under these pairs, and
    every pair of names that meets is aligned by all words.
    """
    named = groups.select("name").distinct().withColumn("words", F.array_distinct(F.split("name", " ")))
    own = F.array_except("words", F.array(*[F.lit(w) for w in sorted({x for v in GROUP_WORDS.values() for x in v.split()})]))
    named = cut_lineage(named.withColumn("words", F.when(F.size(own) > 0, own).otherwise(F.col("words"))))
    words = named.select("name", F.size("words").alias("n"), F.explode("words").alias("token"))
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    counts = cut_lineage(counts)
    near = near_pairs(counts)
    # A word stands for itself and for each more frequent word an edit from it, so two near words share a key.
    keys = counts.join(near.join(counts.withColumnsRenamed({"token": "other", "df": "m"}), "other"), "token").where("m > df or (m = df and other < token)").select("token", F.col("other").alias("key"))
    keys = counts.select("token", F.col("token").alias("key")).unionByName(keys)
    listed = keys.join(counts.withColumnRenamed("token", "key"), "key").groupBy("token").agg(F.collect_set("key").alias("near"), F.max("df").alias("df"))
    ranked = words.join(listed, "token").withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("df", "token"))).where(F.col("r") <= F.floor(F.col("n") / 2) + 2)
    keyed = ranked.groupBy("name", "n").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("ks"))
    twos = F.flatten(F.transform("ks", lambda k, i: F.transform(F.slice("ks", i + 2, F.size("ks")), lambda o: F.concat_ws(" ", k, o))))
    # Names of up to three words may meet names of two, which share a single word.
    met = keyed.select("name", F.explode(F.when(F.col("n") <= 3, F.concat("ks", twos)).otherwise(twos)).alias("key"))
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.ceil(F.col("c") / CLASS_BLOCK).cast("int").alias("k"))
    sized = met.join(sizes, "key")
    left = sized.withColumn("b", F.pmod(F.xxhash64("name"), F.col("k")).cast("int"))
    right = sized.select("key", F.col("name").alias("other"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("b"))
    pairs = left.join(right, ["key", "b"]).where("name < other").select("name", "other").distinct()
    compared = pairs.join(named.select("name", "words"), "name").join(named.select(F.col("name").alias("other"), F.col("words").alias("others")), "other").where(F.abs(F.size("words") - F.size("others")) <= 1)

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [align(list(a), list(b), forms) >= SAME_GROUP for a, b in zip(batch["words"], batch["others"])]
            yield batch.loc[good, ["name", "other"]]

    return compared.mapInPandas(fits, "name string, other string")


def link_names(names: DataFrame, key: str, name: str, short_forms: DataFrame | None = None) -> DataFrame:
    """``key``, ``entity``: ids that stand for one person or one group share ``entity``, the smallest of them.

    ``names`` has a row for every way an id is typed (repeated rows count once). ``short_forms`` has ``given_name`` and
    ``short_form``; it must be a small table of fixed size, as such tables of names are, and is checked to be.

    Null, empty and unreadable names say nothing; an id with no readable name has no row. Very long names are read
    whole, all their tokens being aligned. An empty table gives no rows. Extra columns are ignored.
    """
    forms: dict[str, set[str]] = {}
    if short_forms is not None:
        listed = short_forms.select("given_name", "short_form").limit(100_001).collect()
        if len(listed) > 100_000:
            raise ValueError("short_forms has more than 100000 rows")
        for full, short in ((r[0], r[1]) for r in listed if r[0] and r[1]):
            forms.setdefault(fold(short), set()).add(fold(full))
    kind = names.schema[key].dataType.simpleString()
    typed = names.select(F.col(key).alias("id"), F.col(name).alias("raw")).dropna().distinct()
    parsed = cut_lineage(typed.mapInPandas(_parse, _NAMES.format(id=kind)))

    # Names in either order: how often each word is a given and how often a family name where the order is plain.
    plain = parsed.where("kind = 'person'").select("id", "name").distinct()
    family, first = F.split(F.split("name", "\\|")[0], " "), F.split(F.split("name", "\\|")[1], " ")[0]
    written = (F.length(first) > 1) & ~F.endswith(first, F.lit("."))
    seen = plain.select(F.inline(F.concat(F.when(written, F.array(F.struct(first.alias("w"), F.lit(1).alias("g")))).otherwise(F.array()), F.transform(family, lambda w: F.struct(w.alias("w"), F.lit(0).alias("g"))))))
    leans = seen.groupBy("w").agg(F.log((F.sum("g") + 0.5) / (F.sum(1 - F.col("g")) + 0.5)).alias("lean"))
    opened = parsed.where("kind = 'open'").select("id", "name").distinct()
    words = opened.select("id", "name", F.posexplode(F.split("name", " ")).alias("i", "w"))
    leaned = words.join(leans, "w", "left").groupBy("id", "name").agg(F.array_sort(F.collect_list(F.struct("i", "w", F.coalesce("lean", F.lit(0.0)).alias("lean")))).alias("x"))
    turned = leaned.select("id", F.col("x.w").alias("words"), F.col("x.lean").alias("lean")).mapInPandas(_orient, f"id {kind}, name string")
    closed = F.concat(F.regexp_replace(F.split("name", "\\|")[0], " ", ""), F.lit("|"), F.split("name", "\\|")[1])
    persons = cut_lineage(plain.unionByName(turned).select("id", closed.alias("name")))

    groups = parsed.where("kind = 'group'").select("id", F.concat(F.lit("="), "name").alias("name")).distinct()
    alike = group_pairs(parsed.where("kind = 'group'"), forms).select(F.explode(F.array("name", "other")).alias("n"), F.concat_ws("=", F.lit(""), "name", "other").alias("who")).select(F.concat(F.lit("="), "n").alias("name"), "who")
    whose = link_persons(persons, forms).unionByName(groups.select("name", F.col("name").alias("who")).distinct()).unionByName(alike)
    # An id stands for itself by a name that may be several persons'.
    who = persons.unionByName(groups).join(whose, "name").select("id", F.coalesce("who", F.concat(F.lit("#"), F.col("id").cast("string"))).alias("who"))
    carried = cut_lineage(who.withColumn("first", F.min("id").over(Window.partitionBy("who"))).select("id", "first").distinct())
    # Ids that carry names of several persons join these; all other ids already have their smallest mate.
    lowest = carried.withColumn("low", F.min("first").over(Window.partitionBy("id")))
    linked = connected_components(lowest.where("first <> low").select(F.col("first").alias("src"), F.col("low").alias("dst")))
    mates = lowest.select("id", "low").distinct().join(linked.withColumnRenamed("id", "low"), "low", "left")
    return mates.select(F.col("id").alias(key), F.coalesce("component", "low").alias("entity"))


__all__ = ["align", "assignment", "deletes", "given_fit", "group_pairs", "label_persons", "link_names", "near_pairs", "one_edit", "one_person", "parse_name", "token_fit"]
