"""Column expressions for text and time that the operators share.  Every function takes and returns a Column."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that topic comparison ignores.  Fixed values.
TOPIC_STOPWORDS = (
    "the a an and or but if then than that this these those to of for in on at by with from as is are was were be been being it its we you they he she "
    "i me my our their your about into over after before so because there here today will can could should would"
).split()
#: Words that caption matching ignores.  Fixed values.
CAPTION_STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would shall should may might must can could to of in for on with at by from as "
    "into through during before after above below between out off over under again further then once here there when where why how all each every both few "
    "more most other some such no nor not only own same so than too very just because but and or if while about up it its this that these those what which "
    "who whom they them their we us our you your he him his she her i my me"
).split()
#: Phrases that announce a change of topic.  Fixed values.
TRANSITION_CUES = ["next", "now", "moving on", "let'?s turn to", "on the other hand", "in summary", "to recap", "finally"]
#: A cue between characters that are neither letters, digits nor underscores, in a form that Java and RE2 read alike.
CUE_PATTERN = r"(^|[^\p{L}\p{N}_])(" + "|".join(TRANSITION_CUES) + r")([^\p{L}\p{N}_]|$)"
#: Texts that stand for no text.  Fixed values.
PLACEHOLDERS = ["", "...", "…", "tbd", "n/a", "na", "none", "summary", "highlights"]


def clean_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def words(text: Column) -> Column:
    """White-space separated words; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


@F.arrow_udf(T.StructType([T.StructField("shared", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("best", T.ArrayType(T.IntegerType()))]))
def shared_words(texts: pa.Array, others: pa.Array) -> pa.Array:
    """``shared``: for each of ``texts``, how many distinct words it shares with each of ``others`` (both arrays without nulls); ``best``: the first two texts by each of these numbers."""

    # A printable text has no white space but blanks.
    found = lambda t: set(t.split() if t.isprintable() else re.findall(r"[^ \t\n\r\f\x0B]+", t))

    def compared(own, other):
        where = {}  # a word's others, a field of 32 bits each
        for k, t in enumerate(other):
            for w in found(t):
                where[w] = where.get(w, 0) + (1 << 32 * k)
        met = [sum([where.get(w, 0) for w in found(t)]) for t in own]
        columns = [[m >> 32 * k & 0xFFFFFFFF for m in met] for k in range(len(other))]
        first = {i for c in columns for i in sorted(range(len(own)), key=c.__getitem__, reverse=True)[:2]}
        return {"shared": list(zip(*columns, strict=True)) if other else [[] for _ in own], "best": sorted(first)}

    kind = pa.struct([("shared", pa.list_(pa.list_(pa.int32()))), ("best", pa.list_(pa.int32()))])
    return pa.array([compared(t, o) for t, o in zip(texts.to_pylist(), others.to_pylist(), strict=True)], kind)


def token_count(text: Column) -> Column:
    """The default token counter: white-space words.  Operators take any other ``Column -> Column``."""
    return F.size(words(text))


def topic_tokens(text: Column) -> Column:
    """Distinct lower-case ASCII words of three or more characters, in text order, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(TOPIC_STOPWORDS)))


def caption_tokens(text: Column) -> Column:
    """Lower-case ASCII words of two or more characters, repeats kept, without stop words."""
    found = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9 \t\n\r\f]", " "), r"[ \t\n\r\f]+")
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(CAPTION_STOPWORDS))


def summary_tokens(keywords: Column, heading: Column, main_idea: Column) -> Column:
    """Topic tokens of the keywords; where these give none, of heading and main idea."""
    own = topic_tokens(F.array_join(keywords, " "))
    return F.when(F.size(own) > 0, own).otherwise(topic_tokens(F.concat_ws(" ", heading, main_idea)))


def has_cue(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(CUE_PATTERN)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two bags of words, words of more than five letters counting double; 0 where either is empty."""
    weight = lambda w: F.when(F.length(w) > 5, 2).otherwise(1)
    count = lambda bag, w: F.size(F.filter(bag, lambda x: x == w))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    # Only shared words have a smaller count above zero, and the larger counts are what both bags hold without these.
    low = total(F.transform(F.array_intersect(a, b), lambda w: F.least(count(a, w), count(b, w)) * weight(w)))
    high = total(F.transform(a, weight)) + total(F.transform(b, weight)) - low
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(low / high)


def format_time(seconds: Column) -> Column:
    """MM:SS, or H:MM:SS from an hour on; fractions are cut off."""
    s = F.floor(F.coalesce(seconds, F.lit(0.0))).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    short = F.concat(two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))
    return F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), short)).otherwise(short)


def duration_human(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on."""
    return F.when(seconds >= 3600, format_time(seconds)).otherwise(F.regexp_replace(format_time(seconds), "^0", ""))


def upload_date(day: Column) -> Column:
    """YYYYMMDD -> YYYY-MM-DD by position."""
    return F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 100))


def anchor(heading: Column) -> Column:
    """The name under which a heading is linked.  The patterns are fixed values."""
    plain = F.regexp_replace(F.lower(F.trim(heading)), r"[#\[\](){}|\\^`]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[ \t\n\r\f\x0B]+", "-"), "^-+|-+$", "")


def output_key(title: Column, source_id: Column) -> Column:
    """Folder name of a source: its title with unsafe characters and runs of white space as underscores, cut to 60 characters, and its id."""
    plain = F.regexp_replace(clean_ends(F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', "_")), r"[ \t\n\r\f]+", "_")
    return F.concat(F.left(plain, F.lit(60)), F.lit("_"), source_id.cast("string"))


def compact(text: Column, limit: int = 180) -> Column:
    """One line of at most ``limit`` characters."""
    one = clean_space(F.coalesce(text, F.lit("")))
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.rtrim(F.left(one, F.lit(limit - 3))), F.lit("...")))


def spoken(text: Column) -> Column:
    """Markdown made speakable: no bold marks, bullets, images or tags.  The patterns are fixed values."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\*\*([^*]+)\*\*", "$1")
    out = F.regexp_replace(out, r"(?m)^- ", "")
    out = F.regexp_replace(F.regexp_replace(out, r"!\[[^\]]*\]\([^)]+\)", ""), r"<[^>]+>", "")
    return clean_ends(out)


def sentences(text: Column) -> Column:
    """Split behind . ! ? and white space; parts are trimmed and blank ones dropped."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t\n\r\f]+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, clean_ends), lambda s: s != "")


def strict_sentences(text: Column) -> Column:
    """Like :func:`sentences`, but split only where a capital letter A-Z follows."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t\n\r\f]+([A-Z])", "$1\u0001$2"), "\u0001")
    return F.filter(F.transform(parts, clean_ends), lambda s: s != "")


def outline(start: Column, end: Column, heading: Column, main_idea: Column, key_points: Column, keywords: Column, transition: Column) -> Column:
    """A summary on one line, with at most four points and eight keywords; null parts are left empty."""
    some = lambda xs, n, by: F.array_join(F.slice(F.coalesce(xs, F.array().cast("array<string>")), 1, n), by)
    parts = [
        F.concat(F.lit("["), format_time(start), F.lit("-"), format_time(end), F.lit("] "), F.coalesce(heading, F.lit("")), F.lit(": "), F.coalesce(main_idea, F.lit(""))),
        F.concat(F.lit("Points: "), some(key_points, 4, "; ")), F.concat(F.lit("Keywords: "), some(keywords, 8, ", ")), F.concat(F.lit("Transition: "), F.coalesce(transition, F.lit("continue"))),
    ]
    return F.concat_ws(" | ", *parts)


def clean_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def is_placeholder(text: Column) -> Column:
    one = F.lower(clean_space(F.coalesce(text, F.lit(""))))
    return one.isin(PLACEHOLDERS) | one.rlike(r"^[.\-• ]+$") | (F.length(one) < 4)


def style_guidance(style: Column) -> Column:
    """What a prompt says about the wanted style; unknown styles count as well explained."""
    key = F.replace(F.lower(F.trim(F.coalesce(style, F.lit("")))), F.lit("-"), F.lit("_"))
    brief = F.lit("Give the main takeaway in few words and leave background out.")
    teach = F.lit("Teach: build intuition, link each step to the one before, say why each idea matters.")
    clear = F.lit("Explain clearly, keep the steps of an argument and define terms where needed.")
    return F.when(key == "concise", brief).when(key == "educational", teach).otherwise(clear)
