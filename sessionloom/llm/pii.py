"""Personal data: fixed patterns, and more spans by weak supervision.

The fixed patterns give the base spans, which always stay. Further candidates (long tokens with
digits, groups of digits, pairs of capitalised words) get votes of regex, gazetteer and context
labelers. Expectation-maximisation over the counts of vote patterns of the whole corpus estimates how
far each labeler can be trusted, and its posteriors train a logistic span classifier, which decides.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import by_size, give_back, small_batches, stored

BASE = ("email", "ip", "card", "phone")
ADDED = ("name", "number", "secret")
KINDS = (*BASE, *ADDED)

# The base patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Fixed values of the labelers.
#: Given and family names that are common in the four languages; a caller may give longer lists.
GIVEN_NAMES = frozenset("""
Aaron Adam Adrian Agnes Alain Albert Alejandra Alejandro Alexander Alice Alicia Amelia Ana Andrea Andreas Andrew Angela Anna Anne Anthony Antoine
Antonio Arthur Astrid Barbara Beatriz Ben Benjamin Bernard Bernd Birgit Brigitte Camille Carlos Carmen Caroline Catherine Charles Charlotte Christian
Christine Christopher Claire Claudia Cristina Daniel David Diego Dieter Dominique Edward Elena Elizabeth Emily Emma Eric Erika Ernst Eva Fernando
Florian Francisco François Frank Franz Friedrich Gabriel Georg George Gérard Gisela Grace Guillaume Hannah Hans Heike Heinrich Helen Helga Helmut
Henri Henry Ignacio Inés Ingrid Isabel Isabelle Jack Jacques James Jane Javier Jean Jennifer Jessica Jesús Joachim Johannes John Jonas Jörg José
Joseph Juan Julia Julie Julien Jürgen Karen Karin Karl Katharina Kevin Klaus Laura Laurent Léa Linda Lisa Louis Louise Luca Lucas Lucía Luis Luise
Lukas Manuel Marc Margaret María Maria Marie Mario Mark Markus Marta Martin Mary Matthew Matthias Maximilian Michael Michel Miguel Mónica Monika
Nathalie Nicolas Nicole Olivier Oscar Pablo Patricia Patrick Paul Pedro Peter Philippe Pierre Pilar Rachel Rafael Raúl Rebecca Renate Robert Rosa
Sabine Samuel Sandra Sarah Sebastian Sergio Sofía Sophie Stefan Stephanie Susan Susanne Teresa Thierry Thomas Ursula Ute Valérie Véronique Vicente
Victor Victoria William Wolfgang Xavier Yves
""".split())
FAMILY_NAMES = frozenset("""
Alonso Álvarez Anderson Bailey Baker Bauer Becker Bell Bernard Bertrand Blanc Bonnet Braun Brown Campbell Carter Castillo Castro Clark Collins Cooper
Cruz David Davis Delgado Díaz Domínguez Dubois Dupont Durand Edwards Evans Fernández Fischer Flores Fournier François Frank Fuchs García Garnier Gil
Girard Gómez González Green Guérin Gutiérrez Hall Harris Hartmann Hernández Herrera Hill Hoffmann Howard Hughes Huber Jackson Jiménez Johnson Jones
Kaiser Kelly Klein Koch Köhler König Krause Krüger Lambert Lange Laurent Lefebvre Legrand Lehmann Leroy Lewis López Maier Marín Martin Martínez
Mercier Meyer Miller Mitchell Moore Morales Moreau Morel Moreno Morgan Morris Müller Muñoz Murphy Navarro Nelson Neumann Ortega Ortiz Parker Pérez
Perrin Peters Petit Phillips Ramírez Ramos Reed Richard Richter Rivera Robert Roberts Robinson Rodríguez Rogers Romero Rousseau Roux Rubio Ruiz
Sánchez Sanders Santos Sanz Schäfer Schmid Schmidt Schmitt Schmitz Schneider Scholz Schröder Schubert Schulz Schulze Schwarz Scott Serrano Simon Smith
Stewart Suárez Taylor Thomas Thompson Torres Turner Vargas Vázquez Vincent Vogel Wagner Walker Walter Ward Watson Weber Weiß Werner White Williams
Wilson Winkler Wolf Wood Wright Young Zimmermann
""".split())
COMMON_WORDS = {"The", "And", "Of", "In", "On", "For", "It", "Is", "Was", "This", "That", "With", "As", "Der", "Die", "Das", "Und", "Le", "La", "Les", "El", "Los", "Las", "Un", "De", "New", "North", "South", "United"}
SECRET_PREFIXES = ("AKIA", "ghp_", "gho_", "sk_live", "sk-", "xox", "eyJ", "AIza")
CUES = {
    "name": re.compile(r"(?:\b(?:mr|mrs|ms|dr|name|contact|author|dear|by|herr|frau|señor|señora|monsieur|madame)\b[.:]?\s*)$", re.I),
    "number": re.compile(r"(?:\b(?:phone|tel|telephone|call|fax|mobile|ssn|social security|passport|account|iban|id|telefon|téléphone|teléfono)\b[^\w\n]{0,4})$", re.I),
    "secret": re.compile(r"(?:\b(?:token|secret|password|passwd|pwd|api[_ -]?key|key|bearer|credential)s?\b[\"']?\s*[:=]?\s*[\"']?)$", re.I),
}
AGAINST = re.compile(r"(?:\b(?:page|figure|fig|table|version|isbn|issn|doi|chapter|section|step|commit|revision|sha\d*|md5)\b[^\w\n]{0,3}|[$€£] ?)$", re.I)
_NATIONAL = re.compile(r"\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|\d{3}-\d{2}-\d{4}")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}")
_HEX = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
_DIGITS = re.compile(r"\(?\d[\d().\x20-]{5,}\d")
_UP, _LOW = "A-ZÀ-ÖØ-ÞŒŠŽ", "a-zß-öø-ÿœšž"
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame"
_WORD = rf"[{_UP}][{_LOW}]{{1,20}}(?:-[{_UP}][{_LOW}]{{1,20}})?"
#: Two words with capitals; pairs may share a word, so that a title or rank before a name hides nothing.
_PAIR = re.compile(rf"\b(?=((?!(?:{_TITLES})\b){_WORD} {_WORD})\b)")
_TOKEN = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=-")
LABELERS = ("shape", "check", "gazetteer", "context", "against")
FEATURES = ("one", *KINDS, "long", "longer", "some digits", "mostly digits", "mixed case", "cue", "listed", "shape", "against")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start. The work grows with the text's length."""
    found, end, floor = [], 0, 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            # the longest run of local characters before the @ that a pattern read from the left would take
            at = m.start()
            floor = max(end, floor)
            start = floor + len(text[floor:at].rstrip(_LOCAL))
            if start < at:
                found.append((0, start, m.end()))
                end = m.end()
            floor = at + 1
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _only_digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_only_digits(m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def _tokens_with_digits(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of token characters of 16 or more that hold digits and letters; of ``key=value`` the value."""
    end, n = 0, len(text)
    for m in _DIGIT.finditer(text):
        if m.start() < end:
            continue
        start, low = m.start(), end
        while start > low and text[start - 1] in _TOKEN:
            start -= 1
        end = m.end()
        while end < n and text[end] in _TOKEN:
            end += 1
        inner = text.rfind("=", start, end)
        while inner >= 0 and not text[inner + 1 : end].strip("="):  # padding at the end
            inner = text.rfind("=", start, inner)
        start = max(start, inner + 1)
        if end - start >= 16 and any(c.isalpha() for c in text[start:end]) and _DIGIT.search(text, start, end):
            yield start, end


def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Those of ``spans`` (in order) that none of ``taken`` (in order) overlaps."""
    at = 0
    for start, end in spans:
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at == len(taken) or taken[at][0] >= end:
            yield start, end


def _not_within(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Those of ``spans`` (in order) that lie in none of ``taken`` (in order) as a whole."""
    at, reach = 0, -1
    for start, end in spans:
        while at < len(taken) and taken[at][0] <= start:
            reach = max(reach, taken[at][1])
            at += 1
        if end > reach:
            yield start, end


def candidates(text: str, base: list[tuple[int, int, int]], names: tuple[frozenset, frozenset] = (GIVEN_NAMES, FAMILY_NAMES)) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, votes, features) of base spans and further candidates; codes are small whole numbers."""
    found = [(kind, start, end) for kind, start, end in base]
    taken = sorted((s, e) for _, s, e in base)
    has_digit = _DIGIT.search(text)
    pairs = [m.span(1) for m in _PAIR.finditer(text)]
    numbers = [m.span() for m in _DIGITS.finditer(text) if 7 <= len(_only_digits(m[0])) <= 20] if has_digit else []
    secrets = list(_tokens_with_digits(text)) if has_digit else []
    secrets = list(_not_within(secrets, taken))  # a card number may lie in a longer secret
    numbers = list(_free(numbers, sorted(taken + secrets)))
    found += [(4, *s) for s in pairs] + [(5, *s) for s in numbers] + [(6, *s) for s in secrets]
    out = []
    for kind, start, end in found:
        span, name, before = text[start:end], KINDS[kind], text[max(0, start - 32) : start]
        shape = check = listed = 0
        if kind < 4:
            shape = check = 1  # the pattern and its test of parts, Luhn or length
        elif name == "number":
            shape = 1 if _NATIONAL.fullmatch(span) else -1 if _DATE.search(span) else 0
            check = -1 if len(set(_only_digits(span))) <= 2 or span.isdigit() and len(span) < 9 else 0
        elif name == "secret":
            shape = -1 if AGAINST.search(before) else 1 if _HEX.fullmatch(span) else 0  # a checksum looks like a key
            check = 1 if len(set(span)) >= 10 else -1 if len(set(span)) < 8 else 0
            listed = 1 if span.startswith(SECRET_PREFIXES) else 0
        else:
            first, second = span.split(" ")
            listed = 1 if first.split("-")[0] in names[0] else -1 if first in COMMON_WORDS or second in COMMON_WORDS else 0
            check = 1 if second.split("-")[0] in names[1] else -1 if first == second else 0
            shape = -1 if (start == 0 or before.rstrip()[-1:] in (".", "!", "?", "")) and listed + check < 2 else 0
        cue = CUES[name].search(before) if kind >= 4 else None
        if name == "name" and check > 0 and listed > 0:
            shape = 1
        against = AGAINST.search(before)
        votes = 0
        for v in (shape, check, listed, 1 if cue else 0 if kind < 4 else -1, -1 if against else 0):
            votes = 3 * votes + v + 1
        share = sum(c.isdigit() for c in span) / len(span)
        mixed = span != span.lower() and span != span.upper()
        bits = (len(span) >= 16, len(span) >= 32, 0 < share < 0.6, share >= 0.6, mixed, bool(cue), listed > 0, shape > 0, bool(against))
        features = kind
        for b in bits:
            features = 2 * features + b
        out.append((kind, start, end, votes, features))
    return out


def scan(docs: DataFrame, names: tuple[frozenset, frozenset] = (GIVEN_NAMES, FAMILY_NAMES)) -> DataFrame:
    """doc_id, and the spans of each whole text with their votes and features: one pass over the texts."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end", "votes", "features")]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                rows.append([dict(zip(("kind", "start", "end", "votes", "features"), c, strict=True)) for c in candidates(text, base_spans(text), names)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span)], ["doc_id", "spans"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, spans array<struct<kind:int,start:int,end:int,votes:int,features:int>>")


@dataclass
class SpanModel:
    """Which features make a span personal data; ``reliability`` of each labeler: P(vote | class)."""

    weights: np.ndarray
    reliability: dict[str, list[list[float]]] = field(default_factory=dict)
    cut: float = 0.5

    def accepts(self, features: int) -> bool:
        return bool(1 / (1 + np.exp(-_vector(features) @ self.weights)) >= self.cut)


def _vector(features: int) -> np.ndarray:
    bits = [features >> (8 - i) & 1 for i in range(9)]
    kinds = [float(features >> 9 == i) for i in range(len(KINDS))]
    return np.array([1.0, *kinds, *bits])


def _votes(code: int) -> list[int]:
    out = []
    for _ in LABELERS:
        out.append(code % 3)
        code //= 3
    return out[::-1]


def fit(scanned: DataFrame, *, rounds: int = 100) -> SpanModel:
    """EM and the classifier, over counts of (votes, features) of all spans of the corpus.

    What comes to the driver has a row for each pattern that occurs: at most 3^5 vote patterns times 7
    kinds times 2^9 features, however many documents there are.
    """
    counts = scanned.select(F.explode("spans").alias("s")).groupBy("s.votes", "s.features").agg(F.count("*").alias("n")).collect()
    if not counts:
        return SpanModel(np.zeros(len(FEATURES)) - np.eye(len(FEATURES))[0] * 10)
    counts.sort(key=lambda r: (r["votes"], r["features"]))
    n = np.array([r["n"] for r in counts], float)
    votes = np.array([_votes(r["votes"]) for r in counts])
    x = np.stack([_vector(r["features"]) for r in counts])
    onehot = np.eye(3)[votes]  # patterns x labelers x votes
    # from the sum of votes; the classes keep their sides since each labeler starts better than chance
    p = 1 / (1 + np.exp(-1.5 * ((votes - 1).sum(1) - 0.5)))
    for _ in range(rounds):
        table = []
        for weight in (1 - p, p):
            t = np.einsum("i,ijv->jv", n * weight, onehot) + 1
            table.append(t / t.sum(1, keepdims=True))
        prior = (n @ p + 1) / (n.sum() + 2)
        logit = np.log(prior / (1 - prior)) + np.einsum("ijv,jv->i", onehot, np.log(table[1] / table[0]))
        new = 1 / (1 + np.exp(-logit.clip(-30, 30)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    # logistic regression on the posteriors, by Newton steps with a small ridge; log counts keep rare patterns heard
    weight, w = np.log1p(n), np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        gradient = x.T @ (weight * (q - p)) + 0.05 * w
        hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return SpanModel(w, {name: [table[c][j].tolist() for c in (0, 1)] for j, name in enumerate(LABELERS)})


def _decided(spans: list, model: SpanModel, cache: dict) -> list[tuple[int, int, int]]:
    out = []
    for kind, start, end, features in spans:
        if kind >= len(BASE):
            if features not in cache:
                cache[features] = model.accepts(features)
            if not cache[features]:
                continue
        out.append((kind, start, end))
    return sorted(out)


def report(scanned: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans, counts of added spans and of all; a row for each row scanned."""
    kind = scanned.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in ADDED), "n_spans"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            counts, digests, texts, total = [[] for _ in KINDS], [], [], []
            for row in batch.column(1).to_pylist():
                spans = _decided([(s["kind"], s["start"], s["end"], s["features"]) for s in row], model, cache)
                base = [s for s in spans if s[0] < len(BASE)]
                for i, c in enumerate(counts):
                    c.append(sum(s[0] == i for s in spans))
                total.append(len(spans))
                write = lambda some: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in some)
                digests.append(hashlib.sha256(write(base).encode()).hexdigest())
                texts.append(write(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts[: len(BASE)]), pa.array(digests, pa.string()), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in (*counts[len(BASE) :], total))], columns)

    return scanned.mapInArrow(task, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_name long, n_number long, n_secret long, n_spans long")


def find(docs: DataFrame, names: tuple[frozenset, frozenset] = (GIVEN_NAMES, FAMILY_NAMES)) -> DataFrame:
    """Personal data of every text of ``docs`` (doc_id, text). ``names``: gazetteers of given and family names.

    A null text is empty and gives no spans; repeated rows each get a row; other columns are ignored;
    an empty table gives none.
    """
    scanned = stored(scan(docs, names))
    return report(scanned, fit(scanned))


def redact(docs: DataFrame, model: SpanModel, text_col: str = "text", names: tuple[frozenset, frozenset] = (GIVEN_NAMES, FAMILY_NAMES)) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; null texts stay null, all columns stay.

    Spans that overlap or touch inside one another become one, named by the first.
    """
    small_batches(docs.sparkSession)
    columns_of = docs.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        at = columns_of.index(text_col)
        for batch in (part for whole in batches for part in by_size(whole, at)):
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                if text:
                    spans = _decided([(k, s, e, f) for k, s, e, _, f in candidates(text, base_spans(text), names)], model, cache)
                    parts, done, last = [], 0, 0
                    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
                        if start >= last:
                            parts += [text[done:start], f"[{KINDS[kind].upper()}]"]
                        last = max(last, end)
                        done = last
                    text = "".join([*parts, text[done:]])
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, columns_of)
        give_back()

    return docs.mapInArrow(task, docs.schema)
