"""Guidebook text -> text with field tags, one rule per function.

Every rule maps the whole text of a document to a new whole text, so a table of documents is
marked in one narrow stage without any shuffle; ``mark_document`` chains them in the fixed
order.  A tag pair looks like ``|title start| ... |title end|``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from placesearch.functions.lexicon import BOOK_STATES, STATE_LINES
from placesearch.functions.text import (
    BLANK, NONSPACE, SPACE, WS, bind, collapse, each_line, gsub, lines, strip, unlines,
)

# Exceptions of the guidebook's layout.
ALWAYS_TITLE = "K. LAMAY'S"
NEVER_TITLE = "B.J."
ALWAYS_URL = "cornelldairybar.cfm"
ALWAYS_ADDRESSES = {
    "605 8th Ave. S. Nashville, Tennessee": "605 8th Ave. S. Nashville, TN",
    "Fulton and Dorrance St. at Kennedy Plz. Providence, RI":
        "Fulton and Dorrance St. at Kennedy Plz. Providence, RI",
    "226 6th St. Augusta, GA": "226 6th St. Augusta, GA",
    "Windy Hill Rd. Smyrna, GA": "Windy Hill Rd. Smyrna, GA",
    "Lane Packing Company 50 Lane Rd. Fort Valley, GA":
        "Lane Packing Company 50 Lane Rd. Fort Valley, GA",
    "E2918 State Hwy. M-67 Trenary, MI": "E2918 State Hwy. M-67 Trenary, MI",
    "3131 S. 27th St. Milwaukee, WI": "3131 S. 27th St. Milwaukee, WI",
    "N2030 Spring St. Stockholm, WI": "N2030 Spring St. Stockholm, WI",
    "1516 W. 2nd Ave. Spokane, WA": "1516 W. 2nd Ave. Spokane, WA",
    "Highway 75 S. \nLe Mars, IA": "Highway 75 S. Le Mars, IA",
    "Park Ave. & 36th St. South Tucson, AZ": "Park Ave. & 36th St. South Tucson, AZ",
    "San Francisco St. & Old Santa Fe Tr., on the Plaza Santa Fe, NM":
        "San Francisco St. & Old Santa Fe Tr., on the Plaza Santa Fe, NM",
}
URL_ENDINGS = "com|biz|org|net|edu|coop"
MEAL_CODES = "BLD |LD |BL |BD |B |L |D "
FIELDS = ("title", "URL", "address", "phone", "hours", "cost", "content")

_STATE = "(?:" + "|".join(BOOK_STATES) + ")"
_CAP = r"\p{IsUppercase}\p{Nd}"
_BREAK = "\ufdd0"  # a noncharacter: never part of interchanged text


def tagged(field: str, value: str = "$1") -> str:
    return f"|{field} start| {value} |{field} end|"


def normalize_quotes(text: Column) -> Column:
    """Curly single and double quotes become straight ones."""
    return F.translate(text, "‘’“”", "''\"\"")


def left_trim_lines(text: Column) -> Column:
    """Cut leading whitespace of each line; empty lines stay."""
    return gsub(text, rf"(?dm)^{BLANK}+", "")


def drop_state_lines(text: Column) -> Column:
    """Remove the lines that hold nothing but a state name."""
    return unlines(F.filter(lines(text), lambda line: ~strip(line).isin(*STATE_LINES)))


def strip_question_prefix(text: Column) -> Column:
    """Remove a question mark before a line that starts with a capital."""
    return gsub(text, rf"(?dm)^\?{BLANK}*(?=[A-Z])", "")


def mark_urls(text: Column) -> Column:
    """Tag the lines that are a web address.

    The path is one possessive run of characters that holds no double slash: a pattern that repeats
    a group per segment would recurse once per segment, and a long path would end the JVM.
    """
    url = (rf"^{SPACE}*{NONSPACE}{{2,40}}\.(?:{URL_ENDINGS})"
           rf"(?:/(?!{NONSPACE}*?//)(?!/)[\p{{L}}\p{{N}}_\-.#/]*+)?{SPACE}*\z")

    def rule(line: Column) -> Column:
        whole = F.concat(F.lit("|URL start| "), gsub(line, rf"{SPACE}+", ""),
                         F.lit(" |URL end|\n"))
        address = F.concat(F.lit("|URL start| "), gsub(strip(line), r"/\z", ""), F.lit(" |URL end|\n"))
        return (F.when(F.contains(line, F.lit(ALWAYS_URL)), whole)
                .when(F.rlike(line, F.lit(url)), address).otherwise(line))

    return each_line(text, rule)


def mark_addresses(text: Column) -> Column:
    """Tag street addresses, which may run over several lines.

    An address follows a web-address tag or a word with two capitals, starts at a number or a
    road word, and ends at a comma and a state code.  The capitals are sought from the start
    of a word only and nothing after the last state code is searched: both give the same
    matches and keep the work near linear in the text length.
    """
    ending = rf",{SPACE}{_STATE}(?:{SPACE}*\([^)]+\))?"
    capitals = (rf"(?:\G|(?<![^a-z{WS}]))[^A-Za-z{WS}]*+[A-Z][^A-Za-z{WS}]*+"
                rf"[A-Z][^a-z{WS}]*[A-Z{WS}]*?")
    start = (rf"(?:Route{SPACE}+|Exit{SPACE}+|Hwy\.{SPACE}+"
             rf"|(?:[NSEW]\.{SPACE}+)?\p{{Nd}}+)")
    pattern = rf"(\|URL end\||{capitals}){SPACE}*(?<!US{SPACE})({start}[^|]*?{ending})"
    opened, closed = "|address start|", "|address end|"

    def searched(whole: Column) -> Column:
        reach = F.length(F.regexp_extract(whole, rf"(?s)^.*{ending}", 0))
        marked = gsub(F.substring(whole, F.lit(1), reach), pattern,
                      rf"$1\n{opened} $2 {closed}\n".replace(r"\n", "\n"))
        return F.concat(marked, F.substring(whole, reach + 1, F.length(whole)))

    def one_line(part: Column) -> Column:
        address = F.substring_index(part, opened, -1)
        before = F.substring(part, F.lit(1), F.length(part) - F.length(address))
        return F.when(F.contains(part, F.lit(opened)),
                      F.concat(before, F.lit(" "), collapse(address), F.lit(" "))).otherwise(part)

    def marked(whole: Column) -> Column:
        for found, written in ALWAYS_ADDRESSES.items():
            whole = F.replace(whole, F.lit(found), F.lit(f"\n{tagged('address', written)}\n"))
        # every part but the last is closed by an end tag
        parts = bind(F.split(bind(whole, searched), r"\|address end\|", -1), lambda p: F.transform(
            p, lambda part, i: F.when(i < F.size(p) - 1, one_line(part)).otherwise(part)))
        joined = gsub(F.array_join(parts, closed),
                      rf"\|address start\|{SPACE}+\|address start\|", opened)
        return gsub(joined, rf"\|address end\|{SPACE}+\|address end\|", closed)

    # a text without any state after a comma, or an earlier tag, stays as it is
    possible = rf",{SPACE}(?:{_STATE}|Tennessee)|\|address "
    return bind(text, lambda whole: F.when(F.rlike(whole, F.lit(possible)), marked(whole))
                .otherwise(whole))


def mark_phones(text: Column) -> Column:
    """Tag a phone number, or the note that there is none, at a line start."""
    return gsub(text, rf"(?dm)^{BLANK}*(\p{{Nd}}{{3}}-\p{{Nd}}{{3}}-\p{{Nd}}{{4}}|No phone)",
                tagged("phone") + "\n")


def mark_hours(text: Column) -> Column:
    """Tag opening hours: a meal code or a parenthesis up to the first run of dollar signs."""
    return gsub(text, rf"(?dm)^{BLANK}*((?:{MEAL_CODES}|\([^)\n]+\))[^\n]*?\${{1,3}})",
                tagged("hours") + "\n")


def mark_titles(text: Column) -> Column:
    """Tag lines in capitals whose first word has two capitals or digits in a row."""
    always, never = (ALWAYS_TITLE.replace(".", r"\."), NEVER_TITLE.replace(".", r"\."))
    first_word = rf"(?={NONSPACE}*?[{_CAP}][^{WS}\p{{L}}{_CAP}]*[{_CAP}])"
    shape = rf"(?!{never}{BLANK}*$){first_word}(?=[^\n]*\p{{IsUppercase}})"
    body = rf"([^\p{{IsLowercase}}|\n]*[^\p{{IsLowercase}}|{WS}])"
    return gsub(text, rf"(?dm)^{BLANK}*(?:(?={always}{BLANK}*$)|{shape}){body}{BLANK}*$",
                tagged("title"))


def mark_cost(text: Column) -> Column:
    """Move dollar signs at the end of the hours, or alone on a line, to a field of their own."""
    text = gsub(text, rf"\|{SPACE}*(\${{1,3}}){SPACE}*\|hours end\|",
                f" |hours end|\n{tagged('cost')}\n")
    return gsub(text, rf"(?dm)^{BLANK}*(\${{1,3}}){BLANK}*$", tagged("cost"))


def mark_remaining_content(text: Column) -> Column:
    """Tag each run of lines without a pipe as one content block; empty runs vanish."""
    parts = F.split(gsub(text, r"(?dm)^([^\n|]*\|[^\n]*)$", f"{_BREAK}$1{_BREAK}"), _BREAK, -1)
    # parts alternate: free lines, tagged line, free lines, ...
    blocks = F.transform(parts, lambda part, i: F.when(i % 2 == 1, part).otherwise(
        bind(strip(part), lambda body: F.when(body != "", F.concat(
            F.lit("|content start| "), body, F.lit(" |content end|"))))))
    return unlines(F.filter(blocks, lambda block: block.isNotNull()))


def title_spacing(text: Column) -> Column:
    """One empty line before every title but the first."""
    mark = "|title start|"

    def spread(body: Column) -> Column:
        reach = F.instr(body, mark) + len(mark) - 1
        rest = gsub(F.substring(body, reach + 1, F.length(body)),
                    r"(?<!\n)\n*+\|title start\|", f"\n\n{mark}")
        return (F.when(F.contains(body, F.lit(mark)),
                       F.concat(F.substring(body, F.lit(1), reach), rest)).otherwise(body))

    return bind(gsub(text, r"(?<!\n)\n++\|title start\|", f"\n{mark}"), spread)


# the rules in order, and whether what a rule leaves behind a tag may start with blanks
RULES = ((drop_state_lines, False), (strip_question_prefix, False), (mark_urls, False),
         (mark_addresses, True), (mark_phones, True), (mark_hours, True), (mark_titles, False),
         (mark_cost, True), (mark_remaining_content, False))


def mark_document(text: Column) -> Column:
    """All rules in their order; lines are kept trimmed throughout."""
    text = left_trim_lines(normalize_quotes(text))
    for rule, leaves_blanks in RULES:
        text = left_trim_lines(rule(text)) if leaves_blanks else rule(text)
    return title_spacing(text)


def tagged_values(text: Column, field: str) -> Column:
    """All values between one tag pair on one line."""
    return F.regexp_extract_all(
        text, F.lit(rf"(?d)\|{field} start\|{SPACE}*(.*?){SPACE}*\|{field} end\|"), F.lit(1))


def field_array(text: Column) -> Column:
    """Every tagged field of a text in order, as structs of field and value."""
    names = "|".join(FIELDS)
    whole = F.regexp_extract_all(
        text, F.lit(rf"(?s)\|({names}) start\|.*?\|\1 end\|"), F.lit(0))
    return F.transform(whole, lambda m: F.struct(
        F.regexp_extract(m, r"^\|(\w+) start\|", 1).alias("field"),
        F.regexp_extract(m, rf"(?s)^\|\w+ start\|{SPACE}*(.*?){SPACE}*\|\w+ end\|\z", 1)
        .alias("value")))
