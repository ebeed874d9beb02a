"""Text and token functions, as Column expressions that stay inside code generation."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATH_SEP, LEAF_SEP, CHUNK_SEP = " > ", " / ", " | "

# Stop words of the name tokenizer.
NAME_STOP = "a an the and or but if in on at to of for with by is are was were be been being have has had do does did will would could should may might shall can this that these those i you he she it we they me him her us them my your his her its our their what which who whom when where why how all each every few more most other some such no not only same so than too very just because as until while".split()
# Stop words of concept titles and labels.
LABEL_STOP = "the a an is are was were be been being have has had do does did will would shall should may might must can could of in on at to for with by from about as into through during before after above below between each all both few more most other some such no nor not only same so than too very just this that these those which who when where why how what and but or if then because while although however therefore thus hence also well used using use based given defined number value values score".split()
# Documentation words that never name a node.
LABEL_BOILERPLATE = "http https href www org com net wiki url link neurolex connectomedb humanconnectome definition category sa sd strongly agree disagree neither somewhat".split()
# Stop words of the evaluation tokens.
EVAL_STOP = "the a an and or of to in for on with by at from as is are be this that these those it its was were has have had not no than then so such can will may group description name label value type using used per each".split()
# Markers in front of descriptions.
MARKERS = "key note notes definition description desc question q item value meaning label".split()
# Openings of definition prose.
BOILERPLATE_OPENINGS = ("the number of", "number of", "the subject", "a subject", "the participant", "a participant", "this measure", "this variable", "calculated across", "calculated as", "the percentage of", "the proportion of", "the total number", "the mean of", "the median of", "the standard deviation of", "the amount of", "the time", "the length of", "expressed as", "defined as", "measured as")
# Stop words of phrases.
PHRASE_STOP = "a an the and or but of in on at by for with about into during through over under above below from to as is are was were be being been have has had do does did this that these those they them their it its he she his her you your we our i my me us not no nor how often when where which who why what lot lots much many more most some any all none very also too just so such only even still one two three first second".split()
# Endings in the order in which they are tried.
ENDINGS = "ization isation ousness iveness ities iness ation ments ness ies ied ing ers ed es er ly s".split()
URL = r"(?i)(https?://\S+|www\.\S+|\b\w+\.(?:org|com|net|gov|edu)\b/?\S*)"


def words(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def safe(x: Column) -> Column:
    """Trimmed text, a null as the empty one."""
    return F.coalesce(F.trim(x.cast("string")), F.lit(""))


def without_urls(x: Column) -> Column:
    """P10."""
    return F.regexp_replace(x, URL, " ")


def spaced(x: Column) -> Column:
    """Words of a text as an array, none of them empty."""
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def name_tokens(x: Column) -> Column:
    """Letters only, lower case, over 2 characters, no stop words."""
    own = F.split(F.lower(F.regexp_replace(x, "[^a-zA-Z]+", " ")), " ")
    return F.filter(own, lambda w: (F.length(w) > 2) & ~w.isin(NAME_STOP))


def attribute_name(x: Column) -> Column:
    """The first clause that is not made of capital markers of 2 to 6 characters only."""
    clauses = F.transform(F.split(x, r"[:\n]"), lambda c: F.trim(c))
    mark = r"^[^\s]{2,6}(\s+[^\s]{2,6})*$"
    fine = F.filter(clauses, lambda c: (c != "") & ~(c.rlike(mark) & (F.upper(c) == c) & c.rlike("[A-Za-z]") & ~c.rlike(r"(^|\s)[^A-Za-z\s]+(\s|$)")))
    return F.coalesce(F.get(fine, F.lit(0)), F.trim(x))


def concept_title(x: Column) -> Column:
    """The segment before the longest later one; empty if it has over 9 words; the whole text without a colon."""
    text = F.trim(x)
    parts = F.split(text, ":")
    lengths = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda s: F.length(F.trim(s)))
    at = F.array_position(lengths, F.array_max(lengths)).cast("int")
    before = F.trim(F.get(parts, at - 1))
    title = F.when(F.size(parts) < 2, text).otherwise(F.when(F.coalesce(before, F.lit("")) == "", text).otherwise(before))
    return F.when(F.regexp_count(title, F.lit("[A-Za-z]+")) > 9, F.lit("")).otherwise(title)


def bound(value: Column, body) -> Column:
    """body(value), with value worked out once: an expression named in a lambda is worked out again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams of low to high tokens, joined by spaces, by n and then position."""
    if low == high == 1:
        return tokens

    def of(t: Column, n: int) -> Column:
        own = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.concat_ws(" ", F.slice(t, i, n)))
        return F.when(F.size(t) >= n, own).otherwise(F.array().cast("array<string>"))

    return bound(tokens, lambda t: F.flatten(F.array(*[of(t, n) for n in range(low, high + 1)])))


def raw_title(x: Column) -> Column:
    """T4: the segment before the longest later one, as it is; the whole text without a colon."""
    parts = F.transform(F.split(x, ":"), lambda s: F.trim(s))
    lengths = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda s: F.length(s))
    return F.when(F.size(parts) < 2, F.trim(x)).otherwise(F.get(parts, F.array_position(lengths, F.array_max(lengths)).cast("int") - 1))


def title_phrases(title: Column, blocked: list[str] | None = None) -> Column:
    """T5: 1- to 4-grams of a title without parentheses, URLs, stop words, boilerplate and blocked words."""
    plain = without_urls(F.regexp_replace(title, r"\([^)]*\)", " "))
    own = F.filter(F.regexp_extract_all(F.lower(plain), F.lit(r"[a-z][a-z\-]+"), F.lit(0)), lambda w: ~w.isin(LABEL_STOP + LABEL_BOILERPLATE + (blocked or [])))
    return ngrams(own, 1, 4)


def own_title_label(title: Column) -> Column:
    """The first 4 content words of a title of at most 7; else empty."""
    own = F.filter(F.regexp_extract_all(title, F.lit(r"[A-Za-z][A-Za-z\-]+"), F.lit(0)), lambda w: ~F.lower(w).isin(LABEL_STOP + LABEL_BOILERPLATE))
    return F.when(F.size(own).between(1, 7), F.concat_ws(" ", F.slice(own, 1, 4))).otherwise("")


def singular(w: Column) -> Column:
    """T10."""
    return F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def without_phrase(tokens: Column, phrase: Column) -> Column:
    """Tokens without a run of the phrase's tokens; if there is none, without each of them."""
    text, run = F.concat(F.lit(" "), F.concat_ws(" ", tokens), F.lit(" ")), F.concat(F.lit(" "), F.concat_ws(" ", phrase), F.lit(" "))
    at = F.position(run, text)
    cut = F.concat(F.substring(text, F.lit(1), at), F.substring(text, at + F.length(run), F.length(text)))
    return F.when(at > 0, spaced(cut)).otherwise(F.filter(tokens, lambda w: ~F.array_contains(phrase, w)))


def string_overlap(label: Column, cluster_words: Column) -> Column:
    """Share of the label's words (3 letters on, no stop words) among the cluster's words."""
    own = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(label), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(LABEL_STOP)))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, cluster_words)) / F.size(own)).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching ratio of two strings; it has no SQL form."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def light_stem(w: Column) -> Column:
    """The first ending that leaves over 2 characters goes."""
    low = F.lower(F.trim(w))
    out = low
    for ending in reversed(ENDINGS):
        out = F.when(low.endswith(ending) & (F.length(low) > len(ending) + 2), F.substring(low, F.lit(1), F.length(low) - len(ending))).otherwise(out)
    return out


def without_markers(x: Column) -> Column:
    """Up to four leading markers such as ``KEY:`` go."""
    return F.regexp_replace(x, r"(?i)^(\s*(?:" + "|".join(MARKERS) + r")\s*:\s*){1,4}", "")


def concept_and_body(x: Column) -> tuple[Column, Column]:
    """What stands before the first colon if it has 1 to 14 words, and the rest; else all and nothing."""
    text = without_markers(F.trim(x))
    head, body = F.trim(F.substring_index(text, ":", 1)), F.trim(F.substring(text, F.instr(text, ":") + 1, F.length(text)))
    splits = (F.instr(text, ":") > 0) & F.size(spaced(head)).between(1, 14)
    return F.when(splits, head).otherwise(text), F.when(splits, body).otherwise("")


def is_boilerplate(x: Column) -> Column:
    """T17."""
    low = F.lower(F.trim(x))
    opens = F.lit(False)
    for opening in BOILERPLATE_OPENINGS:
        opens = opens | low.startswith(opening)
    return (low == "") | opens | (F.size(spaced(low)) > 6)


def is_meaningful(phrase: Column, group_name: Column | None = None) -> Column:
    """T18."""
    p = F.lower(F.trim(phrase))
    tokens = spaced(p)
    content = F.filter(tokens, lambda t: ~t.isin(PHRASE_STOP) & (F.length(t) >= 2))
    fine = (p != "") & ~p.isin(MARKERS) & ~F.get(tokens, F.lit(0)).isin(PHRASE_STOP) & ~F.try_element_at(tokens, F.lit(-1)).isin(PHRASE_STOP) & (F.size(content) > 0) & ~((F.size(tokens) == 1) & p.rlike(r"^\d+$"))
    return fine if group_name is None else fine & (p != F.lower(group_name))


def eval_tokens(x: Column) -> Column:
    """Distinct words of 3 letters on without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z][a-z]{2,}"), F.lit(0))), words(*EVAL_STOP))


@F.pandas_udf(T.StringType())
def title_case(x: pd.Series) -> pd.Series:
    """A capital after each character that is no letter; initcap() looks at white space only."""
    return x.map(lambda s: None if s is None else s.title())


@F.pandas_udf(T.StringType())
def hover(x: pd.Series) -> pd.Series:
    """Escaped for HTML and wrapped to 60 characters a line."""
    import html

    return x.map(lambda s: "<br>".join(textwrap.wrap(html.escape(s or ""), 60)))


def json_in(x: Column) -> Column:
    """What stands from the first brace to the last, after a closed or open think block is gone."""
    plain = F.regexp_replace(x, r"(?s)<think>.*?(</think>|$)", "")
    found = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    return F.when(found == "", None).otherwise(found)

