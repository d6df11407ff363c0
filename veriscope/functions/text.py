"""Text scalars as columns; every one stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and phrases that results depend on.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "for", "with", "by", "from", "as", "is", "are", "was", "were",
    "be", "been", "that", "this", "it", "its", "his", "her", "their", "has", "have", "had", "will",
)
ABSTAIN = "INSUFFICIENT_CONTEXT"
ABSTENTIONS = (
    r"\bINSUFFICIENT_CONTEXT\b",
    r"\bi (don'?t|do not) (know|have enough)\b",
    r"\bnot (enough|sufficient) (information|context)\b",
    r"\bcannot be (answered|determined)\b",
    r"\b(context|text|document|article)s? (provided |given )?do(es)? not (contain|include|mention|provide)\b",
    r"\bprovided (context|text|documents?) does not\b",
    r"\bthere is no (information|mention|reference|article)\b",
    r"\bit is impossible to (determine|answer|tell)\b",
    r"\bno (information|details?) (is |are )?(available|provided|given)\b",
)
ABSTAIN_CLAUSE = f"\nIf the context does not contain the answer, reply exactly: {ABSTAIN}\n"
TEMPLATES = {
    "default": "Answer the question using only the context below.\n{abstain}\nContext:\n{context}\n\nQuestion: {question}\n\nAnswer:",
    "cited": "Answer the question using only the context below.\nCite the passage number in brackets after each claim, like [2].\n"
    "{abstain}\nContext:\n{context}\n\nQuestion: {question}\n\nAnswer:",
    "decompose": "Answer the question using only the context below.\nFirst list the intermediate facts you need, then give the final answer\n"
    'after the marker "ANSWER:".\n{abstain}\nContext:\n{context}\n\nQuestion: {question}\n\nFacts:',
    "closed_book": "Answer the question from your own knowledge.\n{abstain}\nQuestion: {question}\n\nAnswer:",
}
HEADER_LABELS = {"title": "Title", "source": "Source", "published_at": "Published", "author": "Author", "category": "Category"}

_BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0  -     　]"
_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where lambdas within refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """``text`` without white space at its ends (SQL's trim strips spaces alone)."""
    # the one match runs to the end and back over blanks: no try at each blank within the text
    return F.regexp_extract(text, f"(?s)^{_BLANK}*+(.*[^{_BLANK[1:]})?", 1)


def has_text(text: Column) -> Column:
    """Whether anything but white space stands in ``text``."""
    return text.rlike("[^" + _BLANK[1:])


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"{_BLANK}+"), lambda w: w != "")


def normal_tokens(text: Column) -> Column:
    """Words in lower case without ASCII punctuation and articles; none for null."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _PUNCTUATION, "")
    return _words(F.regexp_replace(bare, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " "))


def normalize(text: Column) -> Column:
    return F.array_join(normal_tokens(text), " ")


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalize(prediction) == normalize(gold)).cast("double")


def _times(words: Column, w: Column) -> Column:
    return F.size(F.filter(words, lambda x: x == w))


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the words as multisets; 1 if both are empty, 0 if one is."""
    def f1(s: Column) -> Column:
        p, g = s["p"], s["g"]
        both = F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, w: acc + F.least(_times(p, w), _times(g, w))).cast("double")
        n = (F.size(p) + F.size(g)).cast("double")
        return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(2 * both / n)

    return let(F.struct(normal_tokens(prediction).alias("p"), normal_tokens(gold).alias("g")), f1)


def contains_gold(prediction: Column, gold: Column) -> Column:
    """Whether the gold answer stands in the prediction; yes and no must be its first word."""
    p, g = normalize(prediction), normalize(gold)
    return F.when(g == "", False).when(g.isin("yes", "no"), F.split(p, " ")[0] == g).otherwise(F.contains(p, g))


def nugget_tokens(text: Column) -> Column:
    """The set of content words ``[a-z0-9]+`` of three letters or more."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def support(fact: Column, passage: Column) -> Column:
    """Share of the fact's content words (token arrays) that the passage has; 0 for none."""
    return F.when(F.size(fact) == 0, 0.0).otherwise(F.size(F.array_intersect(fact, passage)) / F.size(fact))


def abstained(answer: Column) -> Column:
    return F.coalesce(answer.rlike("(?i)" + "|".join(ABSTENTIONS)), F.lit(False))


def header(values: dict[str, Column]) -> Column:
    """``Label: value`` lines of the fields that are neither null nor empty."""
    lines = [F.concat(F.lit(f"{HEADER_LABELS.get(k, k.title())}: "), F.nullif(v.cast("string"), F.lit(""))) for k, v in values.items()]
    return F.concat_ws("\n", *lines)


def final_answer(completion: Column) -> Column:
    """What follows the first ``ANSWER:``, or all."""
    at = F.instr(completion, "ANSWER:")
    return strip(F.when(at > 0, F.substring(completion, at + 7, F.length(completion))).otherwise(completion))


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")


def _first_of_each(items: Column, key) -> Column:
    return let(items, lambda a: let(F.transform(a, key), lambda keys: F.filter(a, lambda x, i: F.array_position(keys, key(x)) == i + 1)))


def sub_queries(text: Column, most: int = 3) -> Column:
    """One query a line without bullet, number and quotes; repeats (any case) and blanks left out."""
    lines = F.transform(_lines(text), lambda x: strip(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    lines = F.transform(lines, lambda x: strip(F.regexp_replace(x, r'^"+|"+$', "")))
    return F.slice(_first_of_each(F.filter(lines, lambda x: x != ""), F.lower), 1, most)


def wants_clarification(reply: Column) -> Column:
    text = strip(F.coalesce(reply, F.lit("")))
    return (text != "") & ~F.upper(text).startswith("NONE") & F.contains(text, F.lit("?"))


def claims(text: Column, most: int = 12) -> Column:
    """Bulleted lines, or else long plain lines that do not end in a colon; those over ten characters."""
    whole = strip(F.coalesce(text, F.lit("")))
    marked = F.regexp_extract_all(whole, F.lit(r"(?m)^\s*[-*•]\s*(.+?)\s*$"), 1)
    plain = F.filter(F.transform(_lines(whole), strip), lambda x: (F.length(x) > 15) & ~x.endswith(":"))
    found = F.filter(F.when(F.size(marked) > 0, F.transform(marked, strip)).otherwise(plain), lambda x: F.length(x) > 10)
    return F.when((whole == "") | F.upper(whole).startswith("NONE"), F.array().cast("array<string>")).otherwise(F.slice(found, 1, most))


def verdict(completion: Column) -> Column:
    """SUPPORTED, CONTRADICTED, NEUTRAL or UNPARSED by the first word."""
    word = F.upper(F.coalesce(_words(strip(F.coalesce(completion, F.lit(""))))[0], F.lit("")))
    word = F.when(F.size(_words(F.coalesce(completion, F.lit("")))) == 0, F.lit("")).otherwise(word)
    return F.when(word == "", "UNPARSED").when(word.startswith("SUPPORTED"), "SUPPORTED").when(word.startswith("CONTRADICTED"), "CONTRADICTED").otherwise("NEUTRAL")


def rerank_grade(completion: Column) -> Column:
    """The first digit, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(completion, F.lit("")), "[0-9]", 0), F.lit("")).cast("int")


def says_yes(completion: Column) -> Column:
    return F.coalesce(F.upper(strip(completion)).startswith("YES"), F.lit(False))


def json_block(completion: Column, schema: str) -> Column:
    """The outermost braces of a completion as a struct; null if they do not hold the schema."""
    return F.from_json(F.regexp_extract(completion, r"(?s)\{.*\}", 0), schema)


def prompt(template: str, question: Column, context: Column | None = None, allow_abstain: bool = True) -> Column:
    if template not in TEMPLATES:
        raise ValueError(f"unknown template {template}; there are {', '.join(sorted(TEMPLATES))}")
    text = TEMPLATES[template].replace("{abstain}", ABSTAIN_CLAUSE if allow_abstain else "")
    parts, rest = [], text
    for name, column in (("{context}", context), ("{question}", question)):
        if name in rest:
            before, rest = rest.split(name)
            parts += [F.lit(before), F.coalesce(column, F.lit("")) if column is not None else F.lit("")]
    return F.concat(*parts, F.lit(rest))
