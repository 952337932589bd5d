"""Text expressions: all of them columns that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: words that carry no meaning in a search.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with"]


def strip(c: Column) -> Column:
    """Without any white space at either end (SQL's trim takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c worked out once a row however often f names it: branches of a plain expression work it out again."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def or_default(c: Column, default) -> Column:
    """`default` where c is null, and also where it is an empty string or 0."""
    other = default if isinstance(default, Column) else F.lit(default)
    return F.when(c.isNull() | (c.cast("string").isin("", "0", "0.0")), other).otherwise(c)


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def content_text(full: Column, summary: Column, description: Column) -> Column:
    """What there is of an article: its text, else its summary, else its description; empty without any."""
    return F.coalesce(first_text(full, summary, description), F.lit(""))


def content_hash(title: Column, description: Column) -> Column:
    """sha256 of the stripped, lower-cased title and description; null counts as empty."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))
    return F.sha2(F.lower(strip(joined)), 256)


def summary_hash(title: Column, description: Column) -> Column:
    """sha256 of the title, a space and the description as they are."""
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))), 256)


def chunk_hash(whole: Column, number: Column) -> Column:
    """60 hex digits of a document's hash and the number of the chunk."""
    return F.concat(F.substring(whole, 1, 60), F.lit("_c"), number.cast("string"))


def estimate_tokens(c: Column) -> Column:
    """A token for every four characters, rounded down; null counts as empty."""
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)


def shorten(c: Column, most: int, mark: str = "...") -> Column:
    """The first `most` characters, with a mark where something is left out."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def terms(c: Column) -> Column:
    """Lower-case words of letters and digits, without stop words, as they stand: any language is treated alike."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", " "), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS))


def stems(words: Column) -> Column:
    """Each word of an array without the endings of an English plural, and of -ed and -ing forms.

    -ies becomes -y, -es goes after a hiss, -s after any other letter but s and u; -ed and -ing go if a vowel is left,
    and of a doubled consonant before them, but for l, s and z, one letter. Words of three letters or fewer stay.
    """

    def stem(w: Column) -> Column:
        plural = (
            F.when(w.rlike("[^ae]ies$"), F.regexp_replace(w, "ies$", "y"))
            .when(w.rlike("(ss|sh|ch|x|z)es$"), F.regexp_replace(w, "es$", ""))
            .when(w.rlike("[^su]s$"), F.regexp_replace(w, "s$", ""))
            .otherwise(w)
        )
        bare = F.regexp_replace(plural, "^(.*[aeiouy].*)(?:ing|ed)$", "$1")
        single = F.when(bare != plural, F.regexp_replace(bare, "([b-df-hjkmnp-rtv-x])\\1$", "$1")).otherwise(bare)
        return F.when(F.length(w) <= 3, w).otherwise(single)

    return F.transform(words, stem)


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def feed_name(url: Column) -> Column:
    """The host without any `www.`; what has no host is cut to 50 characters."""
    rest = F.when(F.contains(url, F.lit("//")), F.split_part(url, F.lit("//"), F.lit(2))).otherwise(F.lit(""))
    name = F.replace(F.split_part(rest, F.lit("/"), F.lit(1)), F.lit("www."), F.lit(""))
    return F.when(name != "", name).otherwise(F.substring(url, 1, 50))


def fallback_query(q: Column, most: int = 7) -> Column:
    """The first words of a web query, years and ranges of years left out."""
    words = F.split(F.trim(F.regexp_replace(q, r"\s+", " ")), " ")
    return F.array_join(F.slice(F.filter(words, lambda w: ~w.rlike(r"^\d{4}(-\d{4})?$") & (w != "")), 1, most), " ")


# What the title of a summary and its third paragraph begin with.
TITLE_TAG = r"^\[[\u4e00-\u9fa5a-zA-Z]+\]\s+.+"
THIRD_LABEL = "主编洞察："


def format_issues(title: Column, summary: Column, label: str = THIRD_LABEL) -> Column:
    """What a summary's format lacks: a tag before the title, three paragraphs, bullets in the second, the label before
    the third."""
    parts = F.filter(F.split(strip(F.coalesce(summary, F.lit(""))), r"\n\s*\n"), lambda p: strip(p) != "")
    few = F.size(parts) < 3
    issues = F.array(
        F.when(~F.coalesce(title.rlike(TITLE_TAG), F.lit(False)), F.lit("title")),
        F.when(few, F.lit("paragraphs")),
        F.when(~few & ~F.coalesce(F.try_element_at(parts, F.lit(2)).rlike(r"(?m)^·\s+"), F.lit(False)), F.lit("bullets")),
        F.when(~few & ~F.coalesce(F.startswith(F.try_element_at(parts, F.lit(3)), F.lit(label)), F.lit(False)), F.lit("label")),
    )
    return F.array_compact(issues)


def json_in_text(c: Column) -> Column:
    """The JSON in a model's answer: of a ```json fence, else of any fence, else from the first { to the last }."""
    fenced = lambda t: [bound(F.regexp_extract(t, p, 1), lambda x: F.nullif(x, F.lit(""))) for p in (r"(?s)```json\s*(.*?)\s*```", r"(?s)```\s*(.*?)\s*```", r"(?s)(\{.*\})")]
    return bound(c, lambda t: F.coalesce(*fenced(t), t))


def citations(c: Column, label: str) -> Column:
    """What stands in [label：...] marks."""
    return F.regexp_extract_all(c, F.lit(rf"\[{label}：([^\]]+)\]"), F.lit(1))


def weighted_score(impact: Column, milestone: Column, attention: Column, weights=(0.4, 0.35, 0.25)) -> Column:
    """The weighted total of three scores; null unless each is within 0 to 10."""
    if abs(sum(weights) - 1) > 0.01:
        raise ValueError(f"weights add up to {sum(weights)}, not 1")
    total = sum((c * F.lit(w) for c, w in zip((impact, milestone, attention), weights, strict=True)), F.lit(0.0))
    return F.when(impact.between(0, 10) & milestone.between(0, 10) & attention.between(0, 10), total)


def mean_length(c: Column) -> Column:
    """The mean length of the texts of a group, rounded down."""
    return F.call_function("div", F.sum(F.length(c)), F.count("*"))
