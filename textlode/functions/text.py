"""Text expressions. Blanks are those of Python's str.strip and str.split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The public stop word list of Spark's StopWordsRemover for English.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()

# Fixed value: a line of blanks or dashes, which sets the last block of a message apart.
BREAK_LINE = r"(?U)^[\s\x1c-\x1f]*-*[\s\x1c-\x1f]*$"
# Phrases and line starts that mark a quoted line in a newsgroup message.
QUOTE_LINE = r"(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)"

# The Unicode blanks, and the four separators that Python counts as blanks, too.
BLANK = r"(?U)[\s\x1c-\x1f]"
BLANK_START, BLANK_END = r"(?U)^[\s\x1c-\x1f]+", r"(?U)[\s\x1c-\x1f]+$"
# Two or more letters, digits or underscores: the usual TF-IDF token.
TERM = r"[\p{L}\p{N}_]{2,}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """Trim blanks at both ends."""
    return F.regexp_replace(F.regexp_replace(_col(text), BLANK_START, ""), BLANK_END, "")


def words(text: Column | str) -> Column:
    """Whitespace tokens, case kept."""
    return F.filter(F.split(_col(text), f"{BLANK}+"), lambda w: w != "")


def explode_words(df: DataFrame, text: Column | str) -> DataFrame:
    """One row `word` per whitespace token."""
    return df.select(F.explode(F.split(_col(text), f"{BLANK}+")).alias("word")).where(F.col("word") != "")


def word_count(text: Column | str) -> Column:
    return F.when(_col(text).isNotNull(), F.size(words(text)))


def terms(text: Column | str) -> Column:
    """Lower-case TF-IDF terms."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TERM), F.lit(0))


def strip_header(text: Column | str) -> Column:
    """What follows the first empty line; nothing if there is none."""
    text = _col(text)
    at = F.locate("\n\n", text)
    return F.when(at > 0, F.substring(text, at + 2, F.length(text))).when(text.isNotNull(), "")


def strip_footer(text: Column | str) -> Column:
    """Drop the last block of the message, from its last blank or dashed line on."""
    text = _col(text)
    lines = F.split(strip(text), "\n")
    breaks = F.filter(
        F.transform(lines, lambda l, i: F.when(l.rlike(BREAK_LINE), i)),
        lambda i: i.isNotNull(),
    )
    last = F.array_max(breaks)
    return F.when(last > 0, F.array_join(F.slice(lines, F.lit(1), last), "\n")).otherwise(text)


def strip_quotes(text: Column | str) -> Column:
    """Drop quoted lines and the lines that announce them."""
    lines = F.split(_col(text), "\n")
    return F.array_join(F.filter(lines, lambda l: ~l.rlike(QUOTE_LINE)), "\n")


def escape_lines(col: str) -> Column:
    """Line breaks as \\n and \\r, backslashes doubled."""
    out = F.replace(F.col(col), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def unescape_lines(col: str) -> Column:
    """The text that `escape_lines` was given."""
    parts = F.split(col, r"\\\\", -1)
    breaks = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.when(F.col(col).isNotNull(), F.array_join(breaks, "\\"))
