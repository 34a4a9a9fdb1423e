"""Character classes as regular expressions, and the two tables of Unicode blocks.

Classes are written for Java's and RE2's engines alike: neither has Unicode
meanings for the short forms by default, so they are spelled out.
"""

from __future__ import annotations

#: Letters: category L and two that Java 17 does not know yet.
LETTER = r"\p{L}\x{0C5D}\x{0CDD}"
PUNCTUATION = r"\p{P}\x{061D}"
SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
#: Characters with a digit value, which are more than category Nd.
DIGIT = (
    r"\p{Nd}\x{00B2}-\x{00B3}\x{00B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}"
    r"\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"
)
ZERO_WIDTH = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}\x{00AD}]"
CONTROL = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"
#: The last range holds CJK, Hangul and Arabic forms too; counts of emoji follow it as it is.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
#: Characters stripped from both ends of a word.
WORD_EDGE = ".,!?;:\"'()[]{}।॥"

#: Script names of the registry and the preprocessor (table A).
SCRIPTS = [
    ("Devanagari", [(0x0900, 0x097F), (0xA8E0, 0xA8FF)]),
    ("Bengali", [(0x0980, 0x09FF)]),
    ("Gurmukhi", [(0x0A00, 0x0A7F)]),
    ("Gujarati", [(0x0A80, 0x0AFF)]),
    ("Odia", [(0x0B00, 0x0B7F)]),
    ("Tamil", [(0x0B80, 0x0BFF)]),
    ("Telugu", [(0x0C00, 0x0C7F)]),
    ("Kannada", [(0x0C80, 0x0CFF)]),
    ("Malayalam", [(0x0D00, 0x0D7F)]),
    ("Sinhala", [(0x0D80, 0x0DFF)]),
    ("Arabic", [(0x0600, 0x06FF), (0x0750, 0x077F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("Latin", [(0x0000, 0x007F), (0x0080, 0x00FF), (0x0100, 0x017F)]),
    ("Cyrillic", [(0x0400, 0x04FF)]),
    ("CJK", [(0x4E00, 0x9FFF), (0x3400, 0x4DBF)]),
]

#: Unicode blocks of the script analysis (table B).
BLOCKS = [
    (0x0000, 0x007F, "Basic Latin"),
    (0x0080, 0x00FF, "Latin-1 Supplement"),
    (0x0100, 0x017F, "Latin Extended-A"),
    (0x0180, 0x024F, "Latin Extended-B"),
    (0x0250, 0x02AF, "IPA Extensions"),
    (0x0300, 0x036F, "Combining Diacritical Marks"),
    (0x0370, 0x03FF, "Greek"),
    (0x0400, 0x04FF, "Cyrillic"),
    (0x0500, 0x052F, "Cyrillic Supplement"),
    (0x0600, 0x06FF, "Arabic"),
    (0x0700, 0x074F, "Syriac"),
    (0x0750, 0x077F, "Arabic Supplement"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"),
    (0x0A00, 0x0A7F, "Gurmukhi"),
    (0x0A80, 0x0AFF, "Gujarati"),
    (0x0B00, 0x0B7F, "Oriya"),
    (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"),
    (0x0C80, 0x0CFF, "Kannada"),
    (0x0D00, 0x0D7F, "Malayalam"),
    (0x0D80, 0x0DFF, "Sinhala"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x0F00, 0x0FFF, "Tibetan"),
    (0x1000, 0x109F, "Myanmar"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul Jamo"),
    (0x1E00, 0x1EFF, "Latin Extended Additional"),
    (0x2000, 0x206F, "General Punctuation"),
    (0x20A0, 0x20CF, "Currency Symbols"),
    (0x2100, 0x214F, "Letterlike Symbols"),
    (0x2200, 0x22FF, "Mathematical Operators"),
    (0x3000, 0x303F, "CJK Symbols and Punctuation"),
    (0x3040, 0x309F, "Hiragana"),
    (0x30A0, 0x30FF, "Katakana"),
    (0x4E00, 0x9FFF, "CJK Unified Ideographs"),
    (0xFB00, 0xFB4F, "Alphabetic Presentation Forms"),
    (0xFB50, 0xFDFF, "Arabic Presentation Forms-A"),
    (0xFE70, 0xFEFF, "Arabic Presentation Forms-B"),
    (0xFF00, 0xFFEF, "Halfwidth and Fullwidth Forms"),
]


def span(lo: int, hi: int) -> str:
    return rf"\x{{{lo:04X}}}-\x{{{hi:04X}}}"


def script_case(code: str) -> str:
    """SQL: the table A script of the code point, null if none."""
    arms = " ".join("WHEN " + " OR ".join(f"{code} BETWEEN {lo} AND {hi}" for lo, hi in ranges) + f" THEN '{name}'" for name, ranges in SCRIPTS)
    return f"CASE {arms} END"


def block_case(code: str) -> str:
    """SQL: the table B block of the code point, null if none."""
    return "CASE " + " ".join(f"WHEN {code} BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name in BLOCKS) + " END"


def segment_pattern(possessive: bool = True) -> str:
    """Matches, from a letter on, the longest run of letters of one block with the other characters between and after them."""
    other = rf"[^{LETTER}]"
    more = "*+" if possessive else "*"
    runs = [rf"[{span(lo, hi)}](?:[{span(lo, hi)}]|{other}){more}" for lo, hi, _ in BLOCKS]
    every = "".join(span(lo, hi) for lo, hi, _ in BLOCKS)
    return "|".join([*runs, rf"[^{every}](?:[^{every}]|{other}){more}"])
