"""Text rules for names, positions, comments and JSON replies."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from reclutark import catalogs

# The white space removed at both ends and between words, and the vowels folded.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
GAP, LETTER = f"[{WHITE_SPACE}]", f"[^{WHITE_SPACE}]"
ASCII_GAP = r"[ \t\n\r\x0b\x0c\x1c-\x1f]"
ASCII_TEXT = r"\A\p{ASCII}*\z"
ACCENTED, PLAIN = "ÁÉÍÓÚ", "AEIOU"


def strip(c: Column) -> Column:
    """Text without white space at both ends (tabs, line ends and wide blanks too).

    Nearly all cells begin and end with a visible ASCII character once plain blanks are off; seeing that by the order of
    text is cheaper than trimming a list of characters or testing a pattern.
    """
    trimmed = F.trim(c)
    last = F.substring(trimmed, -1, 1)
    visible = (trimmed >= "!") & (trimmed < "\x7f") & (last >= "!") & (last < "\x7f")
    return F.when(visible, trimmed).otherwise(F.btrim(c, F.lit(WHITE_SPACE)))


def strip_upper(c: Column) -> Column:
    return F.upper(strip(c))


def fold_accents(c: Column) -> Column:
    """Upper case with the five acute vowels made plain; Ñ and Ü stay."""
    return F.translate(F.upper(c), ACCENTED, PLAIN)


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def text_or_default(c: Column, default: str = catalogs.UNSPECIFIED) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(default))


def full_name(*parts: Column) -> Column:
    """Parts joined by single blanks; a missing part leaves its two blanks, ends are trimmed."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit(" "), F.coalesce(part, F.lit(""))]
    return strip(F.concat(*pieces[1:]))


def mask_confidential(position: Column, flag: Column, shown: str = "VACANTE") -> Column:
    return F.when(flag.eqNullSafe("SI"), F.lit(shown)).otherwise(position)


def replace_exact(c: Column, mapping: Mapping[str, str]) -> Column:
    """Value looked up in a small dictionary; values that are not in it stay."""
    if not mapping:
        return c
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.coalesce(F.create_map(*pairs)[c], c)


def short_company(c: Column, names: Mapping[str, str] = catalogs.COMPANY_SHORT_NAMES) -> Column:
    return replace_exact(c, names)


def first_word_alias(c: Column, aliases: Mapping[str, str] = catalogs.CHART_ALIASES) -> Column:
    """First word as written, replaced by its nickname if that exact word has one."""
    plain = F.substring_index(F.ltrim(c), " ", 1)
    word = F.when(c.rlike(r"\A[ -~]*\z"), plain).otherwise(F.regexp_extract(c, f"{LETTER}+", 0))
    return replace_exact(F.when(word != "", word), aliases)


def _one_of(listed: Iterable[str]) -> str:
    return "|".join(f"\\Q{word}\\E" for word in listed)


def first_listed_word(c: Column, listed: Sequence[str] = catalogs.RECRUITERS) -> Column:
    """First word, in capitals, that is in the list; NULL if none is."""
    name = F.upper(c)

    def found(gap: str) -> Column:
        return F.regexp_extract(name, f"(?:^|{gap})({_one_of(listed)})(?={gap}|$)", 1)

    # Only text outside ASCII needs the long list of blanks, which is slow to test at every letter.
    word = F.when(c.rlike(ASCII_TEXT), found(ASCII_GAP)).otherwise(found(GAP))
    return F.when(name.rlike(_one_of(listed)), F.nullif(word, F.lit("")))


def any_word_is(c: Column, choice: str, aliases: Mapping[str, str] = catalogs.FILTER_ALIASES) -> Column:
    """True if any word, in capitals and after its alias, is the choice; a missing name never is."""
    meant = sorted(word for word in {*aliases, choice} if aliases.get(word, word) == choice)
    if not meant:
        return F.lit(False)
    name = F.upper(c)
    # The bare search is fast and rules out most names; whole words are only looked for in the rest.
    whole_word = name.rlike(f"(?:^|{GAP})(?:{_one_of(meant)})(?:{GAP}|$)")
    return F.coalesce(name.rlike(_one_of(meant)) & whole_word, F.lit(False))


def json_body(text: Column) -> Column:
    """First ``{`` to last ``}`` of a text without code fences; NULL without braces."""
    bare = F.when(text.contains("```"), F.regexp_replace(text, "```json\\s*|\\s*```", "")).otherwise(text)
    return F.when(text.contains("{"), F.regexp_extract(bare, "(?s)\\{.*\\}", 0))


# Stands after a text that is parsed, to show that the parser has come to its end.
_END = "fin del texto"


def parsed_json(body: Column) -> Column:
    """The value of a text that is one JSON value from end to end, else NULL.

    The parser stops after the first value, so the text is put in a list whose last element must be there, in its place.
    """
    whole = F.try_parse_json(F.concat(F.lit("[0,"), body, F.lit(f',"{_END}"]')))
    at_end = F.try_variant_get(whole, "$[2]", "string").eqNullSafe(F.lit(_END)) & F.try_variant_get(whole, "$[3]", "variant").isNull()
    return F.when(at_end, F.try_variant_get(whole, "$[1]", "variant"))


def text_of(value: Column, path: str) -> Column:
    """What a JSON value holds at a path, if that is text."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(value, path, "string"))


def written(body: Column, value: Column, name: str) -> Column:
    """What an object holds under a name, as written in its text; if the name may stand there twice, the last one's value as JSON."""
    twice = F.size(F.split(body, f'"{name}"\\s*:', 3)) > 2
    last = F.when(F.try_variant_get(value, f"$.{name}", "string").isNotNull(), F.to_json(F.try_variant_get(value, f"$.{name}", "variant")))
    return F.when(twice, last).otherwise(F.get_json_object(body, f"$.{name}"))


def first_of_list(text: Column) -> Column:
    """First element of a text that is a JSON list, any other text as it is."""
    return F.coalesce(F.when(F.ltrim(text).startswith("["), F.get_json_object(text, "$[0]")), text)
