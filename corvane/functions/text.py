"""Source-code text functions: pure column expressions, no Python in the row path."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Languages with comment, signature and outline rules.
LANGUAGES = ("python", "javascript", "java")

# Whitespace as Python's str.strip() and re's \s see it, spelled out so that Java's regex engine
# gives the same answer on every code point.
_SPACE = (
    r"\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = f"[{_SPACE}]"
NON_SPACE = f"[^{_SPACE}]"

# Comment patterns, applied in this order. (?d) keeps '.' and '$' tied to \n alone.
_C_STYLE = (r"(?dm)//.*?$", r"(?dms)/\*.*?\*/")
COMMENT_PATTERNS = {
    "python": (r"(?dm)#.*?$", r'(?dms)""".*?"""', r"(?dms)'''.*?'''"),
    "javascript": _C_STYLE,
    "java": _C_STYLE,
}

# Function-signature patterns.
SIGNATURE_PATTERNS = {
    "python": r"(?U)def\s+(\w+)\s*\([^)]*\)",
    "javascript": r"(?U)function\s+(\w+)\s*\([^)]*\)",
    "java": r"(?U)(?:public|private|protected)?\s*\w+\s+(\w+)\s*\([^)]*\)",
}


def _replace(code: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(code, F.lit(pattern), F.lit(replacement))


def language_guard(language: Column) -> Column:
    """True where the language has rules; other texts pass through untouched."""
    return F.coalesce(language.isin(*LANGUAGES), F.lit(False))


def remove_comments(code: Column, language: Column) -> Column:
    """Drop comments lexically; an unsupported language leaves the text unchanged."""
    branches = None
    # One branch per distinct rule set, so the shared C-style rules are planned once.
    for patterns in dict.fromkeys(COMMENT_PATTERNS.values()):
        names = [n for n, p in COMMENT_PATTERNS.items() if p == patterns]
        cleaned = code
        for pattern in patterns:
            cleaned = _replace(cleaned, pattern, "")
        here = language.isin(*names)
        branches = F.when(here, cleaned) if branches is None else branches.when(here, cleaned)
    return branches.otherwise(code)


def strip(text: Column) -> Column:
    return _replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


# The patterns of white space, strings and numbers below.
def normalize_whitespace(code: Column) -> Column:
    """Collapse blanks and blank lines, strip both ends."""
    return strip(_replace(_replace(code, r"[ \t]+", " "), rf"\n{SPACE}*\n", "\n\n"))


def remove_empty_lines(code: Column) -> Column:
    kept = F.filter(F.split(code, "\n", -1), lambda line: line.rlike(NON_SPACE))
    return F.array_join(kept, "\n")


def normalize_strings(code: Column) -> Column:
    """Replace string literals by a marker; literals may span lines, escapes are not honoured."""
    return _replace(_replace(code, r'"[^"]*"', '"STRING"'), r"'[^']*'", "'STRING'")


def normalize_numbers(code: Column) -> Column:
    return _replace(code, r"(?U)\b\d+\.?\d*\b", "NUM")


def preprocess(
    code: Column,
    language: Column,
    comments: bool = True,
    whitespace: bool = True,
    strings: bool = False,
    numbers: bool = False,
) -> Column:
    """Cleaning chain; each flag switches one step on."""
    if comments:
        code = remove_comments(code, language)
    if whitespace:
        code = normalize_whitespace(code)
    if strings:
        code = normalize_strings(code)
    if numbers:
        code = normalize_numbers(code)
    return code


def function_signature(code: Column, language: Column) -> Column:
    """First function signature, '' when there is none or the language has no rule."""
    found = None
    for name, pattern in SIGNATURE_PATTERNS.items():
        value = F.regexp_extract(code, pattern, 0)
        found = F.when(language == name, value) if found is None else found.when(language == name, value)
    return found.otherwise(F.lit(""))


# Fixed value: what separates words, on lower-cased text.
WORD_BREAK = "[^a-z0-9_]+"


def node_text(text: Column, length: int = 100) -> Column:
    return F.substring(text, 1, length)


def words(text: Column) -> Column:
    """Lower-cased alphanumeric words of a text, in order."""
    return F.filter(F.split(F.lower(text), WORD_BREAK, -1), lambda w: w != "")
