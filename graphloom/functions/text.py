"""Text functions as column expressions: they stay in generated code and push down with the plan."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

Text = Column | str


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _in(value: Column, words) -> Column:
    return value.isin(list(words))


def _starts(value: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(value, F.lit(p))
    return out


# chunking and sections


def sentences(text: Text) -> Column:
    """Split after . ! ? before a capital letter; trimmed, none empty."""
    parts = F.split(F.trim(col(text)), r"(?<=[.!?])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def chunks_fixed(text: Text, size: int, overlap: int) -> Column:
    """Windows of size characters, each size - overlap after the last, while they start inside the text; overlap is less than size."""
    t, step = col(text), size - min(overlap, size - 1)
    windows = F.transform(F.sequence(F.lit(0), F.length(t) - 1, F.lit(step)), lambda i: F.substr(t, i + 1, F.lit(size)))
    return F.when(F.length(t) > 0, windows).otherwise(F.array().cast("array<string>"))


def section_starts(text: Text) -> Column:
    """array<boolean>, one for each line: a # heading, capitals of 80 characters at most, a line that ends in a colon after a blank or no line, or one of 60 characters at most without . ! ? before a blank line."""
    lines = F.split(col(text), "\n")
    at = lambda i: F.trim(F.coalesce(F.get(lines, i), F.lit("")))

    def starts(line, i):
        s = F.trim(line)
        capitals = F.rlike(s, F.lit(r"\p{Lu}")) & (F.upper(s) == s) & (F.length(s) <= 80)
        colon = F.endswith(s, F.lit(":")) & ((i == 0) | (at(i - 1) == ""))
        short = (F.length(s) <= 60) & ~F.rlike(s, F.lit(r"[.!?]$")) & (i < F.size(lines) - 1) & (at(i + 1) == "")
        return (s != "") & (F.rlike(line, F.lit(r"^#{1,6}\s")) | capitals | colon | short)

    return F.transform(lines, starts)


# names


def relation_name(name: Text) -> Column:
    """The canonical name of a relation, by its trimmed lower case; unknown ones stay."""
    names = F.create_map(*[F.lit(x) for kv in fixed.RELATION_NAMES.items() for x in kv])
    return F.coalesce(F.element_at(names, F.lower(F.trim(col(name)))), col(name))


def normal_name(name: Text) -> Column:
    """Lower case, - and _ as spaces, no possessive 's, single spaces."""
    s = F.regexp_replace(F.translate(F.lower(col(name)), "-_", "  "), r"'s\b", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


class Lemmas:
    """A table of lemmas: exceptions by word, and suffixes (ending, what stands for it, least characters before it), of which the longest that fits holds. Words that none fits stay."""

    def __init__(self, exceptions: dict[str, str] | None = None, suffixes: list[tuple[str, str, int]] = ()):
        self.exceptions = dict(exceptions or {})
        self.suffixes = sorted(suffixes, key=lambda s: (-len(s[0]), s[0]))

    def of(self, word: Column) -> Column:
        """The lemma of a word, as an expression that stays in generated code."""
        out = word
        for end, other, least in reversed(self.suffixes):
            fits = F.endswith(word, F.lit(end)) & (F.length(word) >= len(end) + least)
            out = F.when(fits, F.concat(F.substring(word, F.lit(1), F.length(word) - len(end)), F.lit(other))).otherwise(out)
        if self.exceptions:
            table = F.create_map(*(F.lit(x) for kv in sorted(self.exceptions.items()) for x in kv))
            out = F.coalesce(F.element_at(table, word), out)
        return out


def lemmatised(name: Text, lemmas: Lemmas) -> Column:
    """normal_name with each word's lemma."""
    return F.array_join(F.transform(words(normal_name(name)), lemmas.of), " ")


def exact_name(name: Text) -> Column:
    """Lower case letters, digits, underscores and single spaces only."""
    s = F.regexp_replace(F.lower(F.trim(col(name))), r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def words(text: Text) -> Column:
    return F.filter(F.split(F.trim(col(text)), r"\s+"), lambda w: w != "")


def token_overlap(a: Text, b: Text) -> Column:
    """Common distinct words by the larger number of words; both empty 1, one empty 0."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / most)


def split_camel(text: Text) -> Column:
    s = F.regexp_replace(col(text), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.lower(F.regexp_replace(s, r"([a-z])([A-Z])", "$1 $2"))


def normal_token(text: Text) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}\s]", ""))


def safe_local(name: Text) -> Column:
    """A name for the end of a URI: word characters and hyphens, single underscores; empty: entity."""
    s = F.regexp_replace(F.regexp_replace(F.trim(col(name)), r"[^\p{L}\p{N}_-]", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.btrim(s, F.lit("_")), F.lit("")), F.lit("entity"))


def base_name(path: Text) -> Column:
    return F.regexp_extract(col(path), r"([^/]+)/?$", 1)


def edge_id(src: Text, dst: Text, relation: Text) -> Column:
    zero = F.char(F.lit(0))
    return F.substring(F.md5(F.concat(col(src), zero, col(dst), zero, col(relation))), 1, 12)


# predicates


def is_noise(name: Text) -> Column:
    """Not a concept, to the repair."""
    n = F.coalesce(col(name), F.lit(""))
    c = F.lower(F.trim(n))
    match = F.lit(False)
    for p in fixed.NOISE_PATTERNS:
        match = match | F.rlike(c, F.lit(p))
    return (n == "") | (F.length(n) > 60) | _in(c, fixed.NOISE_NAMES) | match | _starts(c, fixed.NOISE_STARTS)


def is_agent_noise(name: Text) -> Column:
    """Not a concept, to the agent."""
    n = F.coalesce(col(name), F.lit(""))
    c = F.lower(F.trim(n))
    wordy = (F.length(n) > 40) & F.rlike(n, F.lit("[ ,]"))
    return (n == "") | (F.length(n) > 50) | F.rlike(c, F.lit(r"^[\d.%]+$")) | _in(c, fixed.AGENT_NOISE_NAMES) | _starts(c, fixed.AGENT_NOISE_STARTS) | wordy


def is_concept_name(name: Text) -> Column:
    raw = F.coalesce(col(name), F.lit(""))
    s = F.trim(raw)
    wordy = (F.length(s) > 45) & F.rlike(s, F.lit("[ ,]"))
    bad = (F.length(raw) > 60) | (s == "") | F.rlike(s, F.lit(r"^[\d.%]+$")) | _starts(F.lower(s), fixed.CONCEPT_STARTS) | wordy | _in(F.lower(s), ["e", "100%", "switch aggro"])
    return ~bad


def definition(text: Text) -> Column:
    """The text cut at 500 characters, or null where it is empty, NONE, under 15 characters or a refusal."""
    s = F.trim(col(text))
    bad = (s == "") | (F.upper(s) == "NONE") | (F.length(s) < 15) | _starts(F.upper(s), fixed.REFUSALS)
    return F.when(~bad, F.substring(s, 1, 500))


def shares_token(name: Text, text: Text) -> Column:
    """A part of the name of two characters or more is in the text."""
    parts = F.split(F.translate(col(name), "-_", "  "), " ")
    t = F.lower(col(text))
    return F.exists(parts, lambda w: (F.length(w) > 1) & F.contains(t, F.lower(w)))


def grounded(name: Text, text: Text) -> Column:
    """The name, or a word of it of four characters or more, is in the text. grounded_or_similar adds the similarity of whole strings."""
    t = F.lower(col(text))
    return F.contains(t, F.lower(F.trim(col(name)))) | F.exists(words(F.lower(col(name))), lambda w: (F.length(w) > 3) & F.contains(t, w))


def grounded_or_similar(name: Text, text: Text, least: float = fixed.GROUNDED_RATIO) -> Column:
    """grounded, or difflib's ratio of name and text is least or more. Texts too long for that by their length stay out of Python."""
    import pandas as pd

    def similar(names: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([t is not None and SequenceMatcher(None, n, t).ratio() >= least for n, t in zip(names, texts, strict=True)], dtype=bool)

    n, t = F.lower(col(name)), F.lower(col(text))
    most = 2.0 * F.least(F.length(n), F.length(t)) / (F.length(n) + F.length(t))
    found = grounded(name, text)
    similar.__annotations__ = {"names": pd.Series, "texts": pd.Series, "return": pd.Series}
    return found | F.pandas_udf(similar, "boolean")(n, F.when(~found & (most >= least - 1e-9), t))


# metrics over texts


def context_recall(claims: Column, facts: Column) -> Column:
    """Share of claims found in the joined facts; no claims: 1."""
    ctx = F.lower(F.array_join(facts, " "))
    return F.when(F.size(claims) <= 0, 1.0).otherwise(F.size(F.filter(claims, lambda c: F.contains(ctx, F.lower(c)))) / F.size(claims))


def content_tokens(text: Column) -> Column:
    stop = F.array(*map(F.lit, fixed.STOPWORDS))
    return F.filter(words(normal_token(text)), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def context_recall_relaxed(claims: Column, facts: Column) -> Column:
    """Share of claims of three content tokens or more of which three quarters are in the facts; none such: 1."""
    ctx = normal_token(F.array_join(facts, " "))
    counted = F.filter(F.transform(claims, content_tokens), lambda t: F.size(t) >= 3)
    good = F.filter(counted, lambda t: F.size(F.filter(t, lambda w: F.contains(ctx, w))) >= 0.75 * F.size(t))
    return F.when(F.size(counted) <= 0, 1.0).otherwise(F.size(good) / F.size(counted))


def entity_recall(entities: Column, facts: Column) -> Column:
    ctx = F.lower(F.array_join(facts, " "))
    hit = F.filter(entities, lambda e: F.contains(ctx, F.lower(e)) | F.contains(ctx, split_camel(e)))
    return F.when(F.size(entities) <= 0, 1.0).otherwise(F.size(hit) / F.size(entities))


def answer_f1(predicted: Text, reference: Text) -> Column:
    """Token F1 of two answers without stop words; both empty 1, reference empty 0."""
    p, r = F.array_distinct(content_tokens(col(predicted))), F.array_distinct(content_tokens(col(reference)))
    both = F.size(F.array_intersect(p, r))
    return F.when((F.size(p) == 0) & (F.size(r) == 0), 1.0).when((F.size(r) == 0) | (F.size(p) == 0), 0.0).otherwise(2.0 * both / (F.size(p) + F.size(r)))


# extraction from texts


def entities_in(text: Text) -> Column:
    """CamelCase words, acronyms of three capitals or more, quoted strings; distinct, in that order. A word ends where Python's \\b
    says so: letters, numbers and _ of any script go on with it."""
    t, whole = col(text), r"(?<![\p{L}\p{N}_])(%s)(?![\p{L}\p{N}_])"
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(whole % "[A-Z][a-z]+(?:[A-Z][a-z]+)+"), 1), F.regexp_extract_all(t, F.lit(whole % "[A-Z]{3,}"), 1), F.regexp_extract_all(t, F.lit(r'"([^"]+)"'), 1)))


def claims(text: Text) -> Column:
    return F.filter(F.transform(F.split(col(text), "[.!?]"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)


def concepts_in(query: Text, stop=fixed.STOPWORDS, most: int = 10) -> Column:
    tokens = F.regexp_extract_all(F.lower(col(query)), F.lit("([a-z0-9]+)"), 1)
    stops = F.array(*map(F.lit, stop))
    return F.slice(F.array_distinct(F.filter(tokens, lambda w: (F.length(w) > 1) & ~F.array_contains(stops, w))), 1, most)


def ngrams(text: Text, low: int = 2, high: int = 4, least: int = 4) -> Column:
    """Phrases of low to high words, of least characters or more."""
    w = words(F.lower(col(text)))

    def of(n):
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    parts = [of(n) for n in range(low, high + 1)]
    return F.filter(F.array_distinct(F.flatten(F.array(*parts))), lambda p: F.length(p) >= least)


def fact_parts(fact: Text) -> Column:
    """struct(subject, attribute, value) of "subject: .., attribute: .., value: ..", null where a part lacks."""
    f = col(fact)
    s, a, v = (F.trim(F.regexp_extract(f, p, 1)) for p in (r"subject:\s*([^,]+)", r"attribute:\s*([^,]+)", r"value:\s*([^|]+)"))
    return F.when((s != "") & (a != "") & (v != ""), F.struct(s.alias("subject"), a.alias("attribute"), v.alias("value")))


def score_in(text: Text) -> Column:
    """The first of 1.0, 0.x, 1, 0 in this precedence; else 0."""
    t = F.coalesce(col(text), F.lit(""))
    got = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (r"\b(1\.0+)\b", r"\b(0\.\d+)\b", r"\b(1)\b", r"\b(0)\b")]
    return F.coalesce(*(F.try_to_number(g, F.lit("9.999999999")).cast("double") for g in got), F.lit(0.0))


def fidelity(url: Text) -> Column:
    """How far the site of a url is trusted, from 0.15 to 1."""
    host = F.lower(F.coalesce(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    out = F.lit(fixed.FIDELITY_DEFAULT)
    for score, pattern in reversed(fixed.FIDELITY):
        out = F.when(F.rlike(host, F.lit(pattern)), score).otherwise(out)
    return out


def fidelity_label(score: Column) -> Column:
    out = F.lit("post")
    for at, name in reversed(fixed.FIDELITY_LABELS):
        out = F.when(score >= at, name).otherwise(out)
    return out


def source_label(ref: Text) -> Column:
    """node:X, edge:A-R-B and dp:E:A as display text."""
    r = col(ref)
    body = F.regexp_replace(r, "^(node|edge|dp):", "")
    parts = F.split(body, "-", 3)
    return F.when(F.startswith(r, F.lit("edge:")) & (F.size(parts) == 3), F.concat_ws(" ", parts)).when(F.startswith(r, F.lit("dp:")), F.replace(body, F.lit(":"), F.lit(" "))).otherwise(body)


def with_sources(base: Text, docs: Column) -> Column:
    return F.concat(col(base), F.when(F.size(docs) > 0, F.concat(F.lit(" [sources: "), F.array_join(docs, ", "), F.lit("]"))).otherwise(""))


def clean_answer(text: Text) -> Column:
    """Without source marks and surplus blanks."""
    s = F.regexp_replace(col(text), r"\[(?:node|edge|dp):[^\]]*\]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[ \t]+", " "), "\n{3,}", "\n\n"))


def strip_fences(text: Text) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(col(text)), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def estimate_tokens(text: Text) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col(text)) / 4))


def html_text(html: Text, most: int | None = None) -> Column:
    """The text of a page: no scripts, styles or navigation; tags become line breaks; at most one empty line and single blanks."""
    s = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?is)<(script|style|nav|footer|header|aside)\b.*?</(script|style|nav|footer|header|aside)\s*>", "\n")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]*>", "\n")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"\s*\n\s*\n\s*", "\n\n")
    s = F.btrim(F.regexp_replace(s, r"\n{3,}", "\n\n"), F.lit(" \n\t\r"))
    return s if most is None else F.substring(s, 1, most)


def fit_budget(chunk: Text, prompt_tokens: Column, budget: int, mark: str = "\n[truncated]") -> Column:
    """The chunk, cut so that it fits a budget of tokens beside a prompt, with a margin of 100 characters; 200 characters stay at least. No budget: the chunk."""
    c = col(chunk)
    over = (prompt_tokens + estimate_tokens(c) - budget) * 4 + 100
    keep = F.greatest(F.lit(200), F.length(c) - over)
    return c if budget <= 0 else F.when(prompt_tokens + estimate_tokens(c) <= budget, c).otherwise(F.concat(F.substr(c, F.lit(1), keep.cast("int")), F.lit(mark)))


def link_content(url: Text, html: Text, sites: list[str]) -> Column:
    """struct(kind, content) of a link: a placeholder that names the url for sites that give no text, the size of a .pdf, else the page's text."""
    u = col(url)
    known = F.coalesce(F.exists(F.array(*map(F.lit, sites)), lambda s: F.contains(u, s)), F.lit(False)) if sites else F.lit(False)
    pdf = F.coalesce(F.endswith(F.lower(u), F.lit(".pdf")), F.lit(False))
    made = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("content"))
    return F.when(known, made("reference", F.concat(F.lit("reference: "), u))).when(pdf, made("pdf", F.concat(F.lit("pdf: "), F.octet_length(F.coalesce(col(html), F.lit(""))).cast("string"), F.lit(" bytes")))).otherwise(made("page", html_text(html)))


def repaired_json(reply: Text) -> Column:
    """A model's reply as JSON text, mended where it can be; null otherwise."""
    import json

    import pandas as pd

    from ..operators.extract import repair_json

    def mend(s: pd.Series) -> pd.Series:
        got = (repair_json(x or "") for x in s)
        return pd.Series([None if g is None else json.dumps(g) for g in got], dtype=object)

    mend.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(mend, "string")(col(reply))
