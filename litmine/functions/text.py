"""Text expressions: sentences, tags, white space, blinding, words. All built-in functions, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "\u0001"

# English stop words, in the usual order of that list.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is
    are was were be been being have has had having do does did doing would should could ought i'm you're he's
    she's it's we're they're i've you've we've they've i'd you'd he'd she'd we'd they'd i'll you'll he'll
    she'll we'll they'll isn't aren't wasn't weren't hasn't haven't hadn't doesn't don't didn't won't wouldn't
    shan't shouldn't can't cannot couldn't mustn't let's that's who's what's here's there's when's where's
    why's how's a an the and but if or because as until while of at by for with about against between into
    through during before after above below to from up down in out on off over under again further then once
    here there when where why how all any both each few more most other some such no nor not only own same so
    than too very
    """.split()
)


def split_sentences(text: Column) -> Column:
    """Array of sentences: a stop mark, white space and a capital or an opening bracket end a sentence."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+([A-Z(])", f"$1{_MARK}$2"), _MARK)


def strip_tags(text: Column) -> Column:
    """Every ``<...>`` that does not run over a line end becomes one blank."""
    return F.regexp_replace(text, "<.*?>", " ")


def squeeze(text: Column) -> Column:
    """Line ends and tabs become blanks, runs of blanks become one, ends are trimmed of blanks."""
    return F.trim(F.regexp_replace(F.translate(text, "\n\t", "  "), " +", " "))


def blind(sentence: Column, ids: Column) -> Column:
    """Lower-case the sentence and put ``XXXX`` for every id, one id after the other."""
    return F.aggregate(ids, F.lower(sentence), lambda acc, x: F.replace(acc, F.lower(x), F.lit("XXXX")))


def content_words(text: Column, min_length: int = 4) -> Column:
    """Distinct lower-case words of letters only, of ``min_length`` or more, without stop words."""
    runs = F.regexp_extract_all(strip_tags(text), F.lit("([a-zA-Z]{%d,})" % min_length), 1)
    words = F.split(F.lower(F.array_join(runs, " ")), " ")
    left_out = ["", *[w for w in STOP_WORDS if len(w) >= min_length and w.isalpha()]]
    return F.array_except(words, F.array(*[F.lit(w) for w in left_out]))


def shorten(text: Column, limit: int) -> Column:
    """Cut a text longer than ``limit`` to one less and add two dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit(".."))).otherwise(text)


def unquote(text: Column) -> Column:
    """Remove double quotes and blanks at the ends; an empty value becomes null."""
    return F.nullif(F.trim(F.replace(text, F.lit('"'), F.lit(""))), F.lit(""))
