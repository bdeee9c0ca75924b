"""Personal information in free text, found by a skip-chain conditional random field and replaced by placeholders.

Patterns propose candidates of five types, with far more reach than they need: disguised e-mail addresses, number
groups, labelled numbers, street addresses in several orders, and pairs of name-like words. A random field over the
candidates of a text decides which are real. Its nodes have features of shape, of the lists and of the words around;
its edges join neighbours along the text and, however far apart, candidates that repeat or resemble each other, so
that a text labels them alike. Inference is loopy belief propagation; the weights are fitted by pseudo-likelihood on
TRAIN_TEXTS labelled texts that are made here from a seed, since no labelled rows are given.

Any two words written as names are a candidate, whether listed or not. What all texts tell of a word is a feature of
its candidates and no gate: words that mostly stand before known family names look like given names, and the other way
round. All such words are kept, as bits of bitmaps of a fixed size, so that none is cut off by their number.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.tables import cut

#: Labelled texts the field is fitted on, its seed, and rounds of message passing.
TRAIN_TEXTS, SEED, ROUNDS = 3000, 11, 6
#: A learned word stands with known partners in so large a share of its pairs: strongly with so many different ones,
#: weakly with one. Bits of each of the four bitmaps of such words; a word that is taken for one by chance has a feature
#: too many, and the share of those is the number of learned words over the bits.
PARTNERS, PARTNER_SHARE, LEARNED_BITS = 3, 0.5, 1 << 24
TYPES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {t: f"[{t.upper()}]" for t in TYPES}

# --- candidates ---------------------------------------------------------------------------------------------------

AT = r"(?: ?[@＠] ?|%40|&#64;|&commat;| ?[(\[{<] ?(?:at|AT) ?[)\]}>] ?| (?:AT|at) (?=[\w-]+(?: (?:DOT|dot) |\.)))"
DOT = r"(?:\.|%2E| ?[(\[{<] ?(?:dot|DOT) ?[)\]}>] ?| (?:DOT|dot) )"
EMAIL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._+-]*(?:%2[Bb][A-Za-z0-9._+-]+)*{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+")
EMAIL_SIGNS = ("@", "＠", "%40", "&#64;", "&commat;", "at)", "at]", "at}", "at>", "AT)", "AT]", " AT ", " at ")
GAPS = " .-\u00a0\u202f\u2009/"
GAP = r"[ .\-\u00a0\u202f\u2009/]"
PHONE = re.compile(
    rf"(?:\+|00)\d{{1,3}}{GAP}?(?:\(\d{{1,4}}\){GAP}?)?\d(?:{GAP}?\d){{5,13}}"
    rf"|\(\d{{3,5}}\){GAP}?\d{{3}}{GAP}\d{{3,4}}"
    rf"|(?:1{GAP})?\d{{3}}(?P<gap>{GAP})\d{{3}}(?P=gap)\d{{4}}"
    rf"|0\d{{2,4}}{GAP}\d{{3,4}}{GAP}\d{{3,4}}"
)
LABEL = (
    r"social(?: security)?(?: (?:no|number|nr))?|ssn|national id|nat(?:ional)? ins(?:urance)?(?: (?:no|number))?|insurance (?:no|number)|ni (?:no|number)|nino"
    r"|passport(?: (?:no|number|nr))?|reisepass(?:-?nr)?|personalausweis(?:-?nr)?|ausweis(?:-?nr)?|dni|nie|nif|cpf|steuer-?id|tax id|id (?:card|no|number)|carte d'identité|n° (?:de )?sécu(?:rité sociale)?"
)
VALUE = r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{3} \d{3} \d{3} \d{2}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{1,2}\d{6,8}[A-Z]?|[XYZ]?\d{7,8}-?[A-Z]|[A-Z][0-9A-Z]{8}|\d{9,12}"
ID_NUMBER = re.compile(rf"(?i:\b(?P<label>{LABEL}))\.?\s?[:=#]?\s?(?P<value>{VALUE})(?![\w-])|(?P<bare>\d{{3}}-\d{{2}}-\d{{4}}|\d{{3}}\.\d{{3}}\.\d{{3}}-\d{{2}})(?![\w-])")
#: One of these stands in every text with a LABEL.
ID_SIGNS = ("ssn", "social", "national id", "nat ins", "nat insurance", "insurance", "ni no", "ni number", "nino", "passport", "reisepass", "ausweis", "dni", "nie", "nif", "cpf", "steuer", "tax id", "id card", "id no", "id number", "carte d", "sécu")
SUFFIX = r"(?:street|st|road|rd|avenue|ave|lane|ln|court|ct|crescent|cres|terrace|close|boulevard|blvd|drive|square|sq)"
WORD = r"[^\W\d_][^\W\d_'’]*"
UNIT = r"(?:unit|flat|apt|apartment|suite|whg|wohnung|apto|piso)\.? ?\d{1,4}[a-z]?,?\s"
NUMBERED = re.compile(rf"(?:{UNIT})?\d{{1,4}}[a-z]?\s(?:st\.? )?{WORD}(?:[ ]{WORD}){{0,2}}?\s{SUFFIX}\b\.?", re.I)
RUE = re.compile(rf"(?:{UNIT})?\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|quai) (?:de la |de l'|des |de |du )?(?:st\. )?{WORD}(?: {WORD})?", re.I)
CALLE = re.compile(rf"\b(?:calle|avenida|plaza|paseo) (?:de la |de los |del |de )?(?:st\. )?{WORD}(?: {WORD}){{0,2}},? \d{{1,4}}[a-z]?\b", re.I)
GASSE = re.compile(r"[^\W\d_-][\w-]*(?:gasse|straße|strasse|weg|platz|allee) \d{1,4}[a-z]?\b", re.I)
FUNCTION_WORDS = {"the", "a", "an", "and", "or", "of", "in", "to", "for", "on", "with", "while", "than", "before", "after", "is", "are", "was", "at", "by", "from"}
#: Words that start sentences and titles.
STARTERS = FUNCTION_WORDS | {"this", "that", "these", "those", "it", "we", "you", "they", "he", "she", "see", "use", "read", "run", "add", "new", "old", "no", "not", "all", "if", "when", "then", "please", "open", "close", "fix", "set", "get", "our", "your", "their", "its", "as", "so", "but", "most", "each", "every", "both", "which", "what", "how", "why"}
SEPARATOR = r"[ \u00a0\u202f]"
WORDS = re.compile(r"[^\W\d_]{2,}")
PART = r"[^\W\d_]{2,}(?:-[^\W\d_]{2,})?"
#: Letters that may start a name, a few small ones among them.
UPPER = "A-ZÀ-ÖØ-ÞĀ-žΑ-ΩА-Я"
CAPITAL = rf"[{UPPER}][^\W\d_]+(?:-[^\W\d_]{{2,}})?"
STRAIGHT_CAPITAL = re.compile(rf"(?<![\w@.+-])(?P<given>(?:[{UPPER}]\.|{CAPITAL}))(?P<middle>{SEPARATOR}[^\W\d_]\.)?[ \u00a0\u202f\n](?P<family>{CAPITAL})(?![\w@])")
TURNED_CAPITAL = re.compile(rf"(?<![\w@.+-])(?P<family>{CAPITAL}),?{SEPARATOR}(?P<given>[{UPPER}]\.|{CAPITAL})(?![\w@])")
STRAIGHT = re.compile(rf"(?<![\w@.+-])(?P<given>(?:[^\W\d_]\.|{PART}))(?P<middle>{SEPARATOR}[^\W\d_]\.)?[ \u00a0\u202f\n](?P<family>{PART})(?![\w@])")
TURNED = re.compile(rf"(?<![\w@.+-])(?P<family>{PART}),?{SEPARATOR}(?P<given>[^\W\d_]\.|[^\W\d_]{{2,}})(?![\w@])")


def plain(word: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


#: Given and family names that are common in several countries.
COMMON_GIVEN = "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan thomas sarah maria anna peter paul laura julia daniel emma lucas sofia carlos jose juan luis ana carmen pierre marie jean claire hans klaus karin stefan giulia marco francesca luca ivan olga elena ahmed fatima omar priya rahul wei mei yuki kenji".split()
COMMON_FAMILY = "smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson taylor moore jackson martin lee thompson white harris clark lewis robinson walker young allen wright scott torres nguyen hill flores muller schmidt schneider fischer weber meyer wagner becker dubois durand moreau rossi russo ferrari ivanov petrov kumar singh patel khan tanaka suzuki chen wang kim park silva santos".split()


def bits_of(word: str, width: int) -> int:
    """The bit of a word in a bitmap of that many bits, as the JVM's xxhash64 gives it."""
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 42) & (width - 1)


class Names:
    """What is known of name words by role: listed, common, or learned from the texts, strongly or weakly."""

    def __init__(self, given: set[str], family: set[str], more_given: set[str] = frozenset(), more_family: set[str] = frozenset(), learned: dict[tuple[str, str], np.ndarray] | None = None):
        self.given, self.family = {g.lower() for g in given}, {f.lower() for f in family}
        self.learned = learned or {}
        self.known = {}
        for role, listed, more, common in (("given", self.given, more_given, COMMON_GIVEN), ("family", self.family, more_family, COMMON_FAMILY)):
            of = dict.fromkeys(common, "common") | {w.lower(): "strong" for w in more} | dict.fromkeys(listed, "listed")
            for w in list(of):
                of.setdefault(plain(w), of[w])
            self.known[role] = of
        self.small: dict[str, bool] = {}

    def may_be_small(self, words: list[str]) -> bool:
        """Whether one of these words in small letters may be of a name: it is listed, common or strongly told of."""
        for w in words:
            found = self.small.get(w)
            if found is None:
                if len(self.small) > 500_000:
                    self.small.clear()
                found = self.small[w] = any(self.status(w, role) in ("listed", "common", "strong") for role in ("given", "family"))
            if found:
                return True
        return False

    def status(self, word: str, role: str) -> str:
        low = word.lower()
        if low in STARTERS:
            return "unknown"
        of = self.known[role]
        found = of.get(low) or (None if low.isascii() else of.get(plain(low)))
        if found is None:
            for strength in ("strong", "weak"):
                bits = self.learned.get((role, strength))
                if bits is not None:
                    at = bits_of(low, len(bits) * 8)
                    if bits[at >> 3] >> (7 - (at & 7)) & 1:
                        return strength
        return found or "unknown"


def style(word: str) -> str:
    return "caps" if word.isupper() and len(word) > 1 else "title" if word[0].isupper() else "lower"


class Candidate:
    """A span that may be personal: its features, and keys of which candidates that resemble each other share one."""

    __slots__ = ("start", "end", "kind", "keys", "features")

    def __init__(self, start: int, end: int, kind: str, keys: tuple[str, ...] | str, features: list[str]):
        self.start, self.end, self.kind, self.features = start, end, kind, features
        self.keys = (keys,) if isinstance(keys, str) else keys


BEFORE, AFTER = re.compile(r"([^\W\d_]+|[^\s\w])\s*$"), re.compile(r"\s*([^\W\d_]+|[^\s\w]|\d)")


def around(text: str, start: int, end: int, kind: str) -> list[str]:
    """Features of the words and signs next to a candidate."""
    left, right = text[max(0, start - 24) : start], text[end : end + 24]
    b, a = BEFORE.search(left), AFTER.match(right)
    before, after = b.group(1).lower() if b else "^" if not left.strip() else "#", a.group(1).lower() if a else "$"
    glued_l = bool(left) and (left[-1].isalnum() or left[-1] in "_-./@+#&" and not (left[-1] in "./" and len(left) > 1 and left[-2] in " *"))
    glued_r = bool(right) and (right[0].isalnum() or right[0] in "_@" or right[0] in ":-./" and len(right) > 1 and right[1].isalnum())
    return [f"{kind}|before={before}", f"{kind}|after={after}", f"{kind}|glued={glued_l:d}{glued_r:d}", f"{kind}|afterstyle={style(a.group(1)) if a and a.group(1).isalpha() else 'sign'}"]


def emails(text: str) -> Iterator[Candidate]:
    for m in EMAIL.finditer(text):
        value = m.group()
        end = m.end()
        last = re.split(DOT, value)[-1]
        remote = text[end : end + 1] == ":" and text[end + 1 : end + 2].isalnum()
        f = ["email", f"email|remote={remote:d}", f"email|ending={'word' if last.isalpha() and len(last) > 1 else 'number'}", f"email|local={len(re.split(AT, value)[0]) > 1:d}"]
        yield Candidate(m.start(), end, "email", (plain(re.split(AT, value)[0]), plain(value)), f + around(text, m.start(), end, "email"))


def phones(text: str) -> Iterator[Candidate]:
    for m in PHONE.finditer(text):
        start, end = m.span()
        if start and (text[start - 1].isalnum() or text[start - 1] in "._"):
            continue
        # numbers that follow the last group are not its own: the groups go until it ends where a word does
        while end < len(text) and (text[end].isalnum() or text[end] == "_") or sum(map(str.isdigit, text[start:end])) > 15:
            end = max(text.rfind(g, start, end) for g in GAPS)
            if end < start + 7:
                break
        value = text[start:end]
        if end < start + 7 or sum(map(str.isdigit, value)) < 7:
            continue
        digits = re.sub(r"\D", "", value)
        kind = "plus" if value[0] == "+" else "zeros" if value[:2] == "00" else "bracket" if value[0] == "(" else "national" if value[0] == "0" else "groups"
        f = ["phone", f"phone|form={kind}", f"phone|digits={min(len(digits), 15)}", f"phone|gaps={''.join(sorted(set(re.sub(r'[0-9]', '', value))))}"]
        yield Candidate(start, end, "phone", (digits[-7:],), f + around(text, start, end, "phone"))


def id_numbers(text: str) -> Iterator[Candidate]:
    for m in ID_NUMBER.finditer(text):
        labelled = m.group("value") is not None
        start, end = m.span("value" if labelled else "bare")
        if start and text[start - 1].isalnum() or not labelled and start and text[start - 1] in "-._/":
            continue
        value = text[start:end]
        shape = re.sub(r"[A-Za-z]+", "A", re.sub(r"\d+", lambda d: str(len(d.group())), value))
        f = ["id", f"id|labelled={labelled:d}", f"id|shape={shape}", f"id|word={value.isalpha():d}"]
        yield Candidate(start, end, "id_number", value, f + around(text, start, end, "id"))


def addresses(text: str, low: str) -> Iterator[Candidate]:
    found = [("number", m) for m in NUMBERED.finditer(text)]
    if "rue " in low or "avenue " in low or "boulevard " in low or "place " in low or "quai " in low or "chemin " in low:
        found += [("rue", m) for m in RUE.finditer(text)]
    if "calle " in low or "avenida " in low or "plaza " in low or "paseo " in low:
        found += [("calle", m) for m in CALLE.finditer(text)]
    if "gasse " in low or "stra" in low or "weg " in low or "platz " in low or "allee " in low:
        found += [("gasse", m) for m in GASSE.finditer(text)]
    for form, m in found:
        start, end = m.span()
        if start and (text[start - 1].isalnum() or text[start - 1] in "._-/:"):
            continue
        words = re.findall(WORD, m.group())
        if form == "rue" and len(words) > 2 and words[-1].islower() and not words[-2].islower():
            end -= len(m.group()) - len(m.group()[: m.group().rindex(words.pop())].rstrip())
        styles = {style(w) for w in words if w.lower() not in {"de", "la", "rue", "st"}} or {"lower"}
        f = ["address", f"address|form={form}", f"address|style={'+'.join(sorted(styles))}", f"address|function={bool(FUNCTION_WORDS & {w.lower() for w in words}):d}", f"address|words={min(len(words), 5)}"]
        yield Candidate(start, end, "address", tuple(plain(w) for w in words if len(w) > 3) or (plain(text[start:end]),), f + around(text, start, end, "address"))


RANK = ("unknown", "weak", "strong", "common", "listed")


def _best(value: str, role: str, names: Names) -> str:
    """The best status of the parts of a word with hyphens."""
    return max((names.status(part, role) for part in value.split("-")), key=RANK.index)


def name_pairs(text: str, names: Names, small: bool) -> Iterator[Candidate]:
    patterns = [("straight", STRAIGHT_CAPITAL, False), ("turned", TURNED_CAPITAL, False)]
    if small:
        patterns += [("straight", STRAIGHT, True), ("turned", TURNED, True)]
    for form, pattern, small_only in patterns:
        at = 0
        while m := pattern.search(text, at):
            at = m.end("given") if form == "straight" else m.end("family")
            given, family = m.group("given"), m.group("family")
            initial = given.endswith(".")
            g_style, f_style = style(given[0] if initial else given), style(family)
            if small_only != (f_style == "lower") or f_style == "lower" and (initial or g_style != "lower"):
                continue
            fs = _best(family, "family", names)
            gs = "initial" if initial else _best(given, "given", names)
            comma = form == "turned" and "," in text[m.end("family") : m.start("given")]
            if initial and g_style == "lower":
                continue
            if "unknown" in (gs, fs):
                # a word that nothing is known of has to be written like its partner, and as a name
                if f_style == "lower" or form == "turned" and not comma or not initial and (g_style != f_style and not (comma and f_style == "caps")):
                    continue
            elif f_style == "lower" and "weak" in (gs, fs):
                continue
            elif form == "turned" and not comma and (gs not in ("listed", "common", "strong") or fs not in ("listed", "common", "strong") or names.status(family, "given") != "unknown"):
                continue
            if gs != "unknown" and fs != "unknown":
                at = m.start("family") if form == "straight" else m.start("given")
            wraps = "\n" in m.group()
            starter = (not initial and given.lower() in STARTERS) + 2 * (family.lower() in STARTERS)
            f = ["name", f"name|form={form}{comma:d}", f"name|given={gs}", f"name|family={fs}", f"name|both={gs}/{fs}", f"name|styles={g_style}/{f_style}", f"name|all={gs}/{fs}/{f_style}{comma:d}", f"name|wraps={wraps:d}", f"name|middle={form == 'straight' and m.group('middle') is not None:d}/{gs}/{plain(given[-2:]) if gs == 'unknown' else ''}", f"name|ends={plain(given[-2:]) if gs == 'unknown' else ''}/{plain(family[-2:]) if fs == 'unknown' else ''}", f"name|starter={starter}"]
            near = around(text, m.start(), m.end(), "name")
            f += near + [f"{x}|{'known' if fs != 'unknown' and gs != 'unknown' else 'half' if fs != 'unknown' or gs not in ('unknown', 'initial') else 'none'}" for x in near]
            yield Candidate(m.start(), m.end(), "name", tuple(plain(w) for w in family.split("-")), f)


def candidates(text: str, names: Names) -> list[Candidate]:
    """All candidates in text order; they may overlap, which the field settles."""
    low = text.lower()
    found: list[Candidate] = []
    if any(s in text for s in EMAIL_SIGNS):
        found += emails(text)
    found += phones(text)
    if any(s in low for s in ID_SIGNS) or BARE.search(text):
        found += id_numbers(text)
    if STREET.search(low):
        found += addresses(text, low)
    found += name_pairs(text, names, names.may_be_small(WORDS.findall(low)))
    found.sort(key=lambda c: (c.start, -c.end))
    return found


BARE = re.compile(r"\d{3}(?:-\d{2}-\d{4}|\.\d{3}\.\d{3}-\d{2})")
STREET = re.compile(rf"\s{SUFFIX}\b|gasse \d|stra(?:ße|sse) \d|weg \d|platz \d|allee \d|\d,? (?:rue|avenue|boulevard|place|quai|chemin) |calle |avenida |plaza |paseo ")

# --- the random field ---------------------------------------------------------------------------------------------


def edges(nodes: list[Candidate]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours, and skip edges between each candidate and the last one that resembles it."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if 0 <= nodes[i + 1].start - nodes[i].end < 60]
    seen: dict[tuple[str, str], int] = {}
    skip = set()
    for i, c in enumerate(nodes):
        for key in c.keys:
            last = seen.get((c.kind, key))
            if last is not None and nodes[last].end <= c.start:
                skip.add((last, i))
            seen[c.kind, key] = i
    return chain, sorted(skip)


class Field:
    """Weights of the features and of the two kinds of edges."""

    def __init__(self, weights: dict[str, float], chain: float, skip: float):
        self.weights, self.chain, self.skip = weights, chain, skip

    def marginals(self, nodes: list[Candidate]) -> list[float]:
        """Log-odds of each candidate being real, by loopy belief propagation."""
        w = self.weights
        unary = [sum(w.get(f, 0.0) for f in c.features) / 2 for c in nodes]
        if len(nodes) < 2:
            return [2 * u for u in unary]
        chain, skip = edges(nodes)
        links = [(i, j, self.chain / 2) for i, j in chain] + [(i, j, self.skip / 2) for i, j in skip]
        near: list[list[tuple[int, int, float]]] = [[] for _ in nodes]
        for e, (i, j, c) in enumerate(links):
            near[i].append((j, 2 * e, c))
            near[j].append((i, 2 * e + 1, c))
        message = np.zeros(2 * len(links))
        coupling = np.tanh(np.repeat([c for *_, c in links], 2)) if links else np.zeros(0)
        source = np.array([x for i, j, _ in links for x in (i, j)], int)
        for _ in range(ROUNDS if links else 0):
            belief = np.array(unary)
            target = source.reshape(-1, 2)[:, ::-1].ravel()
            np.add.at(belief, target, message)
            back = message.reshape(-1, 2)[:, ::-1].ravel()
            message = np.arctanh(np.clip(coupling * np.tanh(belief[source] - back), -0.999999, 0.999999))
        belief = np.array(unary)
        if links:
            np.add.at(belief, source.reshape(-1, 2)[:, ::-1].ravel(), message)
        return list(2 * belief)

    def find(self, text: str, names: Names) -> list[tuple[int, int, str]]:
        """(start, end, type) of what is personal, in order, without overlap."""
        nodes = candidates(text, names)
        if not nodes:
            return []
        odds = self.marginals(nodes)
        best = sorted((c for c in zip(odds, nodes) if c[0] > 0), key=lambda c: (-c[0], c[1].start))
        out: list[tuple[int, int, str]] = []
        for _, c in best:
            if all(c.end <= s or c.start >= e for s, e, _ in out):
                out.append((c.start, c.end, c.kind))
        return sorted(out)


def fit(labelled: list[tuple[str, set[tuple[int, str]]]], names: Names, steps: int = 300, ridge: float = 0.3) -> Field:
    """The field that maximises the ridge-penalised pseudo-likelihood of labelled texts."""
    index: dict[str, int] = {}
    rows, cols, y, chain_sum, skip_sum = [], [], [], [], []
    for text, real in labelled:
        nodes = candidates(text, names)
        label = np.array([(c.start, c.kind) in real for c in nodes])
        sign = np.where(label, 1.0, -1.0)
        by = [np.zeros(len(nodes)), np.zeros(len(nodes))]
        for kind, pairs in enumerate(edges(nodes)):
            for i, j in pairs:
                by[kind][i] += sign[j]
                by[kind][j] += sign[i]
        for i, c in enumerate(nodes):
            for f in c.features:
                rows.append(len(y))
                cols.append(index.setdefault(f, len(index)))
            y.append(label[i])
            chain_sum.append(by[0][i])
            skip_sum.append(by[1][i])
    rows, cols, y = np.array(rows), np.array(cols), np.array(y, float)
    extra = np.stack([chain_sum, skip_sum], 1) if len(y) else np.zeros((0, 2))
    n, k = len(y), len(index)
    w, edge, step_w, step_e = np.zeros(k), np.zeros(2), np.full(k, 1e-8), np.full(2, 1e-8)
    for _ in range(steps):
        z = np.bincount(rows, w[cols], minlength=n) + extra @ edge
        miss = y - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g, ge = np.bincount(cols, miss[rows], minlength=k) - ridge * w, extra.T @ miss - ridge * edge
        step_w += g * g
        step_e += ge * ge
        w, edge = w + 0.4 * g / np.sqrt(step_w), np.maximum(edge + 0.1 * ge / np.sqrt(step_e), 0)
    return Field({f: float(w[i]) for f, i in index.items()}, float(edge[0]), float(edge[1]))


# --- labelled texts made here -------------------------------------------------------------------------------------

#: Sentences with places for made values. None of them stands in the tables the queries run over.
CARRIERS = [
    "Could someone hand this over to {name}? The branch is {hash}.", "{name} wrote the first draft of {thing} last year.", "According to {name} the limit is {n}.", "Dear {name},\nplease find the numbers for {thing} below.", "Kind regards,\n{name}\n{phone}",
    "author = \"{name} <{email}>\"", "Reported-by: {name} <{email}>", "* {name}: owns {thing}\n* {name}: reviews it", "maintainer {name}; mail {email}; line {phone}", "We met at {address}, and {name} took notes.",
    "Parcel for {name}, {address}, two boxes", "invoice to: {name}\nstreet: {address}\nmobile: {phone}\nmail: {email}", "{{\"user\": {{\"fullName\": \"{name}\", \"street\": \"{address}\"}}, \"phone\": \"{phone}\"}}", "<td>{name}</td><td>{phone}</td><td>{email}</td>", "{n};{name};{address};{email}",
    "UPDATE people SET mail = '{email}', tel = '{phone}' WHERE name = '{name}';", "The applicant gave {id} and moved to {address}.", "Her papers say {id}; {name} checked it.", "field 7 held {id} until {hash}", "wrong value {id} for {name}, row {n}",
    "mask {id} before you paste it", "Bitte {name} fragen, Telefon {phone}, wohnt {address}.", "Contactez {name} au {phone} ou {email}.", "Vive en {address}; su correo es {email}.", "His number used to be {phone}, now it is {phone}.",
    "ring {phone} after six", "SMS went to {phone} twice, nothing to {email}", "curl -d mail={email} https://{host}/signup?n={n}", "{email} unsubscribed from {thing}", "login failed for {email} from 10.{n}.3.{d}",
    "cc: {email}, {email}", "The house at {address} has no lift.", "from {address} to {address} it takes {n} minutes", "mr {name} and ms {name} signed {thing}", "I think {name} is right, because {thing} broke. Later {name} fixed it.",
    "Was it {name} who wrote {thing}?", "@todo ask {name}", "Spoke with {name} ({phone}) about {thing}", "| {name} | {email} | {address} |", "{name} ({id}), {address}", "{name} joined; {name} left after {n} days.", "say hello to {name}.", "Owner: {name}", "for {name}, from {name}",
    "{name} called about {thing}.", "the keys are with {name} now", "{name}\n{address}\n{phone}", "phone {phone}, {name} picks up", "meine Adresse ist {address}", "J'habite {address}.", "{thing} was written by {name} and {name} in {n} days",
    "{Role} {name}: {thing} is done", "well done {name}! {thing} is in", "Hooray {name}! {n} to go", "bravo {name}, {thing} passed", "either {address} or {address} for now", "houses: {address} and {address} in the same {noun}", "{Role} {name} rang", "{Role} {name} ({id}) is ours", "{Role} {name}, {address}", "{Role} {name} wants {thing}", "the {role} is {name}, Mobil {phone}", "Zuständig ist {name}, erreichbar {phone}.", "with {name}, {thing} got faster", "as for {name}, {thing} may stay", "thanks to {name}, {thing} is quick", "{name} asked about {thing} again", "{name} tried {thing} and gave up", "is it {name}'s {noun}?", "this is {name}'s desk", "{name}'s badge was found, ring {phone}",
]
DECOYS = [
    "git remote add origin git@{host}:{word}/{word}.git", "rsync -a {word}@10.{d}.{d}.{d}:/srv/{word} .", "npm i @{word}/{word}@{d}.{d}{d}.{d}", "use @{word}.{word}({n}) or list.at({d})", "wrap {thing} with @{word}.{word} first", "scp {hash} {word}@10.{n}", "mark it as @{word}.{word}, call .at({n})", "{word}@192.168.{d}.{n} is down", "tunnel to {word}@10.{n} closed", "order {n4}-{n4}-{d}{d} left the depot at 07:{d}{d}:{d}{d}",
    "see ticket ABC-{n4} and build {n4}.{n}.{d}", "upgrade from {d}.{d}{d}{d}.{d}{d}{d} to {d}.{d}{d}{d}.{d}{d}{d}", "bind 127.0.0.1:{n4}, [::]:{n4}", "from 2023-0{d}-1{d} to 2023-0{d}-2{d}, {n} samples", "shape {d}{d}{d}x{d}{d}{d}x{d}{d}",
    "The {family} {Noun} is slower than the {family} {Noun}.", "{Noun} {Noun} depends on the {family} {Noun}.", "Old {Noun} {Noun} and New {Noun} {Noun}", "Take {Word} {Noun} over {Word} {Noun}.", "{given} is out today", "hi {given}, {thing} is green", "{given} and {given} paired on {thing}",
    "pid {n4}-{d}{d} used {n} MB over {d} days", "both the {family} and its {family}, see {thing}", "{n} Step {Noun} and {d} Phase {Noun}", "{d} Main {Noun} or {d} Old {Noun} {Noun}", "Walk {d} streets and {d} lanes down the drive", "he waited {n} ms in the close handler",
    "2024-1{d}-2{d} 1{d}:3{d}:{d}{d},{d}{d}{d} INFO {word}.{word} took={n} id={hash}", "serial {d}{d}{d}-{d}{d}{d}{d}{d}-{d}{d} on the label", "run {n4} of {n4} at offset {n}{n4}", "Great {Noun}! Please {Verb} the {Noun}.", "{Verb} The {Noun} Before Lunch", "## {Verb} {Noun}\n\n{Noun} {Noun} {Verb}s {thing}.",
    "a {family} in the {word} and a {family} by the {word}", "class {Noun}{Noun} extends {Noun} {{ {Word} {word}; }}", "Ticket {n4}, process {n4}, order {n4}{n4}", "{Noun} {Noun}, {Noun} {Noun} and {Noun}", "Deploy to {Word} {Noun} failed on {host}:{n4}", "{given} {verb}s the {noun}", "the {noun} {family} {verb}s {thing}", "the {small} {noun} and a {small} {noun}", "its {small}, {small} or {noun}", "{Verb} {given} in the {noun}",
    "{family} {Noun} 2.{d}", "{n}x{n} {Noun} Square {Noun}", "a place to park, the way home, {n} paths", "ref #{n4}: {Noun} {Verb}s", "{Word} {Word} shipped on Monday", "In {Word} {Noun} the {noun} is {n}",
]
#: What people are called by what they do.
ROLES = "tenant driver patient engineer author editor client member buyer seller caller visitor passenger subscriber user manager lawyer teacher student nurse doctor worker neighbour owner guest analyst tester officer".split()
#: Ordinary words for titles of things.
NOUNS, VERBS = "parser loader filter queue cache index worker server client router schema module bridge monitor service engine buffer cluster gateway scheduler handler runner tracker pipeline ledger window".split(), "check merge split update remove review test rename move sort".split()


def made_words(rng: random.Random, count: int) -> list[str]:
    """Words that look like names of no language."""
    out = set()
    while len(out) < count:
        w = "".join(rng.choice("b br c ch d dr f g gr h j k kl l m n p r s sch st t th v w z".split()) + rng.choice("a e i o u ei ou á ü".split()) for _ in range(rng.randint(2, 3))) + rng.choice(["", "n", "s", "ck", "ll", "rt", "haugh", "ez", "sky", "dy"])
        out.add(w)
    return sorted(out)


def training_names(listed: Names, seed: int = SEED) -> tuple[Names, list[str], list[str]]:
    """Names for training, given words and family words: listed, common and made ones, of which the texts tell much, little or nothing."""
    rng = random.Random(seed)
    names, pools = Names(listed.given, listed.family), []
    for role, own, common in (("given", listed.given, COMMON_GIVEN), ("family", listed.family, COMMON_FAMILY)):
        made = made_words(rng, 400)
        for w in made:
            told = rng.choice(["strong", "strong", "weak", "weak", "unknown"])
            if told != "unknown":
                names.known[role].setdefault(w, told)
        # the listed words a third of the draws, whatever their number
        pools.append(sorted(own) * (1 + 300 // max(1, len(own))) + common * 2 + made)
    return names, *pools


def trained(listed: Names) -> Field:
    """The field fitted on TRAIN_TEXTS made texts."""
    return fit(made_texts(listed), training_names(listed)[0])


def made_texts(names_listed: Names, count: int = TRAIN_TEXTS, seed: int = SEED, carriers: list[str] = CARRIERS, decoys: list[str] = DECOYS) -> list[tuple[str, set[tuple[int, str]]]]:
    """Labelled texts: carriers and decoys filled with made values, with the starts of what is personal."""
    rng = random.Random(seed)
    _, given, family = training_names(names_listed, seed)
    title = lambda w: "-".join(p[:1].upper() + p[1:] for p in w.split("-"))
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 3)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hex_ = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(7))

    def name() -> str:
        g, f = title(rng.choice(given)), title(rng.choice(family))
        f2, i = title(rng.choice(family)), chr(65 + rng.randrange(26))
        return rng.choice([f"{g} {f}"] * 3 + [f"{g} {f}-{f2}", f"{g} {i}. {f}", f"{i}. {f}", f"{f.upper()}, {g}", f"{f}, {g}", f"{f}, {i}.", f"{g} {f}".upper(), f"{g} {f}".lower(), f"{g}\u00a0{f}"])

    def email() -> str:
        local = rng.choice([word(), f"{word()}.{word()}", f"{word()}+{word()}", f"{word()}_{word()}", f"{word()}{num(2)}", f"{word()}-{word()}"])
        domain = [word(), *([word()] if rng.random() < 0.5 else []), rng.choice(["example", "test", "invalid", "org", "net", "com"])]
        at, dot = rng.choice([("@", ".")] * 5 + [(" @ ", "."), ("(at)", "."), ("%40", "."), (" [at] ", " [dot] "), (" AT ", " DOT ")])
        value = local.replace("+", "%2B" if at == "%40" else "+") + at + dot.join(domain)
        return value.upper() if at == "@" and rng.random() < 0.2 else value

    def phone() -> str:
        a, b = rng.choice(["212", "415", "617", "808"]), f"555-01{num(2)}"
        return rng.choice([f"+1 ({a}) {b}", f"({a}) {b}", f"1-{a}-{b}", f"{a}-{b}", f"{a}.{b.replace('-', '.')}", f"+1{a}{b.replace('-', '')}", f"+44 7700 900{num(3)}", f"+44\u00a07700\u00a0900{num(3)}", f"07700 900 {num(3)}", f"+44 (0)20 7946 0{num(3)}", f"+33 1 99 00 {num(2)} {num(2)}", f"0049 30 23125 {num(3)}", f"+49-30-23125-{num(3)}", f"+61 491 570 {num(3)}"])

    def id_number() -> tuple[str, str]:
        up = lambda: chr(65 + rng.randrange(26))
        ssn = f"9{num(2)}-{num(2)}-{num(4)}"
        return rng.choice([("SSN ", ssn), ("", ssn), ("ssn=", ssn.replace("-", "")), ("social ", ssn.replace("-", " ")), ("national id ", f"000 {num(3)} {num(3)} {num(2)}"), ("passport ", up() + up() + num(7)), ("Passport No: ", up() + num(7)), ("insurance no. ", "QQ" + num(6) + up()), ("NI number ", f"QQ {num(2)} {num(2)} {num(2)} {up()}"), ("DNI ", f"{num(8)}-{up()}"), ("CPF ", f"000.{num(3)}.{num(3)}-{num(2)}"), ("Ausweis-Nr. ", "L" + num(8))])

    def address() -> str:
        w = " ".join(word().title() for _ in range(rng.randint(1, 2)))
        s, n = rng.choice(["Street", "St.", "Road", "Rd", "Avenue", "Ave", "Lane", "Court", "Crescent", "Terrace", "Close", "Blvd"]), str(rng.randint(1, 250))
        v = rng.choice([f"{n} {w} {s}"] * 3 + [f"{n}b {w} {s}", f"{n} {w}\n{s}", f"Flat {num(2)}, {n} {w} {s}", f"Unit 5, {n} {w} {s}", f"{n}, rue de {w}", f"Calle de {w} {n}", f"{w.split()[-1]}gasse {n}", f"{w.split()[-1]}straße {n}", f"{n} St. {w} {s}"])
        return rng.choice([v, v, v, v.upper() if v[0].isdigit() else v, v.lower() if v[0].isdigit() else v])

    out = []
    slot = re.compile(r"\{(\w+)\}")
    for _ in range(count):
        text, real, last = "", set(), None
        for _ in range(rng.randint(1, 4)):
            sentence = rng.choice(carriers if rng.random() < 0.6 else decoys).replace("{{", "\x01").replace("}}", "\x02")
            at = 0
            for m in slot.finditer(sentence):
                text += sentence[at : m.start()].replace("\x01", "{").replace("\x02", "}")
                what = m.group(1)
                if what == "id":
                    label, value = id_number()
                    text += label
                    real.add((len(text), "id_number"))
                elif what in ("name", "email", "phone", "address"):
                    value = {"name": name, "email": email, "phone": phone, "address": address}[what]()
                    if what == "name" and last and rng.random() < 0.2:
                        value = last
                    last = value if what == "name" else last
                    real.add((len(text), what))
                else:
                    value = {"hash": hex_, "n": lambda: str(rng.randint(1, 19999)), "n4": lambda: num(4), "d": lambda: num(1), "word": word, "Word": lambda: word().title(), "host": lambda: f"{word()}.example", "thing": lambda: rng.choice([f"{word()}_{word()}", f"`{word()}`", f"{word()}.{word()}", f"lib/{word()}.py", f"the {word()} {word()}"]), "given": lambda: title(rng.choice(given)), "family": lambda: title(rng.choice(family)), "Role": lambda: rng.choice(ROLES).title(), "role": lambda: rng.choice(ROLES), "Noun": lambda: rng.choice(NOUNS).title(), "noun": lambda: rng.choice(NOUNS), "small": lambda: rng.choice(family), "Verb": lambda: rng.choice(VERBS).title(), "verb": lambda: rng.choice(VERBS)}[what]()
                text += value
                at = m.end()
            text += sentence[at:].replace("\x01", "{").replace("\x02", "}") + rng.choice([" ", "\n", "\n\n"])
        out.append((text, real))
    return out


# --- over tables --------------------------------------------------------------------------------------------------


def learned(texts: DataFrame, text_col: str, given: set[str], family: set[str]) -> dict[tuple[str, str], np.ndarray]:
    """Bitmaps of given and family words, strong and weak, from all pairs of capitalised words in all texts.

    The pairs are counted in the JVM, with a combiner. Every word that passes has its bit, of LEARNED_BITS a bitmap.
    """
    pattern = r"(?=((\p{Lu}\p{L}+)[ \u00a0](\p{Lu}\p{Ll}+)))\p{Lu}\p{L}+"
    pairs = texts.select(F.explode(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1))).alias("pair"))
    counted = cut(pairs.groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    two = F.split("pair", "[ \u00a0]")
    counted = counted.select(F.lower(two[0]).alias("first"), F.lower(two[1]).alias("second"), "n")
    roles = []
    for role, word, partner, known, listed in (("given", "first", "second", family, given), ("family", "second", "first", given, family)):
        is_known = F.col(partner).isin(sorted(w.lower() for w in known))
        words = counted.groupBy(F.col(word).alias("word")).agg(F.count_if(is_known).alias("partners"), F.sum(F.when(is_known, F.col("n")).otherwise(0)).alias("with_known"), F.sum("n").alias("n"))
        good = words.where((F.col("partners") > 0) & (F.col("with_known") >= PARTNER_SHARE * F.col("n")) & ~F.col("word").isin(sorted({w.lower() for w in listed | known} | STARTERS)))
        roles.append(good.select(F.lit(role).alias("role"), F.when(F.col("partners") >= PARTNERS, "strong").otherwise("weak").alias("strength"), F.xxhash64("word").alias("v")))
    found = cut(roles[0].unionByName(roles[1]), "learned")
    return {(role, strength): bitmap(found.where((F.col("role") == role) & (F.col("strength") == strength)).select("v"), LEARNED_BITS) for role in ("given", "family") for strength in ("strong", "weak")}


BLOCK = 1 << 19


def bitmap(hashes: DataFrame, width: int) -> np.ndarray:
    """Packed bits of hashes (a column v), merged by tasks in blocks: at most width / 8 bytes here."""

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            at = pdf["v"].to_numpy() & (width - 1)
            for block in np.unique(at // BLOCK):
                held.setdefault(block, np.zeros(BLOCK, bool))[at[at // BLOCK == block] % BLOCK] = True
        if held:
            yield pd.DataFrame({"block": list(held), "bits": [np.packbits(b).tobytes() for b in held.values()]})

    out = np.zeros(width // 8, np.uint8)
    by_block = hashes.repartition(F.shiftright(F.col("v").bitwiseAND(width - 1), 19))
    for r in by_block.mapInPandas(merged, "block long, bits binary").toLocalIterator():
        out[r["block"] * (BLOCK // 8) :][: BLOCK // 8] |= np.frombuffer(r["bits"], np.uint8)
    return out


def prepared(texts: DataFrame, parts: DataFrame, text_col: str = "body") -> tuple[Names, Field]:
    """The names, listed and learned, and the fitted field."""
    rows = parts.where("name_part is not null").select("name_part", "name_role").collect()  # the given list of names
    given, family = {r[0] for r in rows if r[1] == "given"}, {r[0] for r in rows if r[1] == "family"}
    bits = learned(texts, text_col, given, family) if given and family else {}
    return Names(given, family, learned=bits), trained(Names(given, family))


def found(texts: DataFrame, parts: DataFrame, id_col: str = "id", text_col: str = "body") -> DataFrame:
    """(log_id, pii_type, span_start, span_end): each piece in each row; null and empty texts have none.

    span_start is the place of its first character, in code points, span_end the place after its last. Repeated rows
    are each reported; rows with a null id are left out.
    """
    rows = texts.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    model = texts.sparkSession.sparkContext.broadcast(prepared(rows, parts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, field = model.value
        for pdf in batches:
            out = [(i, kind, start, end) for i, body in zip(pdf["id"].tolist(), pdf["body"].tolist()) for start, end, kind in field.find(body, names)]
            if out:
                yield pd.DataFrame(out, columns=["log_id", "pii_type", "span_start", "span_end"])

    return rows.mapInPandas(run, "log_id long, pii_type string, span_start long, span_end long")


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join([*out, text[at:]])


def redacted(texts: DataFrame, parts: DataFrame, id_col: str = "id", text_col: str = "body") -> DataFrame:
    """(id, body): every row, each piece replaced by its typed placeholder, all else unchanged; null stays null."""
    model = texts.sparkSession.sparkContext.broadcast(prepared(texts.where(F.length(text_col) > 0), parts, text_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, field = model.value
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "body": [b if b is None else replaced(b, field.find(b, names)) for b in pdf["body"]]})

    rows = texts.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("body"))
    return rows.mapInPandas(run, "id string, body string").select(F.expr("try_cast(id AS bigint)").alias("id"), "body")
