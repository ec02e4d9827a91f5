"""Text expressions. Character classes are spelled out so that results equal Python's Unicode string methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift.functions.geometry import bind

#: Characters that str.isspace, \s and str.split agree on, as the inside of a class.
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same characters as a string, for trimming.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Letters and letter-like numerals, as in [^\W\d_].
LETTERS = r"\p{L}\p{Nl}\p{No}"
#: Kana, CJK ideographs, hangul.
CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}"
#: Str.isdigit beyond decimal digits.
DIGITS = r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}"
#: Punctuation stripped from a token's ends, and what may stand inside one.
EDGE_MARKS = ".,;:!?()[]{}\"'«»“”‘’"
INNER_MARKS = r"\-./:,'’_%&+@#"
#: Glyphs that strokes and borders are read as.
STROKES = rf"lI1|!ǀ{WS}"
#: Marks of image addresses that are not content.
JUNK_IMAGE = "(?i)(sprite|icon|logo|avatar|pixel|tracking|spacer|blank|1x1)"
#: Suffixes of images.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".tiff")

#: The flattening steps in order: (pattern, replacement with $ groups). (?md) ends lines at \n only.
FLATTEN_STEPS = (
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"`{1,3}([^`]*)`{1,3}", "$1"),
    (rf"(?md)^#{{1,6}}[{WS}]*", ""),
    (r"[*_]", ""),
    (rf"(?md)^[{WS}]*[-+][{WS}]+", ""),
    (rf"(?md)^[{WS}]*>[{WS}]?", ""),
    (rf"(?md)^[{WS}]*\|", ""),
    (r"\|", " "),
    (rf"(?md)^[{WS}]*[-:|{WS}]+[{WS}]*$", ""),
    (r"\n{3,}", "\n\n"),
)


def strip(text: Column) -> Column:
    """The text without blanks at its ends. Make it a column before it is used more than once."""
    return F.btrim(text, F.lit(WS_CHARS))


def to_plaintext(markdown: Column) -> Column:
    """Markdown reduced to plain text by the ordered steps."""
    for pattern, new in FLATTEN_STEPS:
        markdown = F.regexp_replace(markdown, pattern, new)
    return strip(markdown)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WS}]+"), lambda x: x != "")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WS}]++"))


def words(text: Column) -> Column:
    """Runs of two letters or more that hold no CJK character."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{2,}}"), F.lit(0)), lambda w: ~w.rlike(f"[{CJK}]"))


def odd_share(text: Column) -> Column:
    """Share of characters that are neither letter, number nor blank; null for an empty text."""
    return F.try_divide(F.length(F.regexp_replace(text, rf"[\p{{L}}\p{{N}}{WS}]++", "")).cast("double"), F.length(text).cast("double"))


def has_repeat(text: Column) -> Column:
    """Five times the same character in a row."""
    return text.rlike(r"(?d)(.)\1{4}")


def only_strokes(text: Column) -> Column:
    return text.rlike(rf"\A[{STROKES}]+\z")


#: What a token must hold to be jumbled: a letter, a digit and an odd mark.
_JUMBLED = (r"\p{L}", f"[{DIGITS}]", rf"[^\p{{L}}\p{{N}}{INNER_MARKS}]")


def jumbled(token: Column) -> Column:
    """Letters, digits and odd marks mixed in one token of three characters or more."""
    bare = F.btrim(token, F.lit(EDGE_MARKS))
    return (F.length(bare) >= 3) & bare.rlike(_JUMBLED[0]) & bare.rlike(_JUMBLED[1]) & bare.rlike(_JUMBLED[2])


def mostly_jumbled(text: Column) -> Column:
    """Two tokens or more, half of them jumbled or more. Texts without a digit are not cut into tokens."""
    half = bind(tokens(text), lambda all_: (F.size(all_) >= 2) & (F.size(F.filter(all_, jumbled)) * 2 >= F.size(all_)))
    return F.when(text.rlike(_JUMBLED[1]), half).otherwise(F.lit(False))


def slug(title: Column, default: str = "webpage") -> Column:
    """A title as part of a file name: at most 60 characters."""
    bare = F.regexp_replace(F.regexp_replace(title, rf"[^\p{{L}}\p{{N}}_\-]+", "_"), r"\A_+|_+\z", "")
    short = F.substring(F.lower(bare), 1, 60)
    return F.when(short == "", F.lit(default)).otherwise(short)


def path_stem(path: Column) -> Column:
    """Last part of a path without its last suffix; a leading dot is no suffix."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")


def percent_decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def split_list(text: Column, default: str = "en") -> Column:
    """Comma-separated names; the default if there is none."""
    return bind(F.filter(F.transform(F.split(text, ","), strip), lambda x: x != ""), lambda names: F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(default))))


def yaml_scalar(value: Column) -> Column:
    """A plain or quoted scalar. Only ASCII blanks are trimmed."""
    v = F.btrim(value, F.lit(" \t\r\n"))
    inner = F.substring(v, F.lit(2), F.length(v) - 2)
    single = (F.length(v) >= 2) & v.startswith("'") & v.endswith("'")
    double = (F.length(v) >= 2) & v.startswith('"') & v.endswith('"')
    decoded = F.from_json(F.concat(F.lit('{"v":'), v, F.lit("}")), "v string").getField("v")
    return F.when(single, F.replace(inner, F.lit("''"), F.lit("'"))).when(double, F.coalesce(decoded, inner)).otherwise(v)
