"""Regular expressions of the prose rules, in Java's dialect, with Unicode classes spelt out."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word characters as the rules mean them; plain \s and \w are ASCII in Java.
SPACE = r"\t\n\x0B\f\r\x85\p{Z}"
WORD = r"\p{L}\p{Mn}\p{Nd}\p{Pc}"
S, W = f"[{SPACE}]", f"[{WORD}]"
#: All characters of ``SPACE``.
SPACES = "\t\n\x0b\f\r\x85 \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: A word boundary; where the next character, or the last one, is of a word.
B = f"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"
OPENS, CLOSES = f"(?<!{W})", f"(?!{W})"

# Lines. What opens a fence, heading, list item or table row.
FENCE = rf"^{S}*(?:`{{3,}}|~{{3,}})"
BLANK = rf"^{S}*$"
HEADING = rf"(?d)^{S}{{0,3}}#{{1,6}}{S}++(.*)$"
LIST_ITEM = rf"(?d)^{S}{{0,3}}(?:[-*+]|\p{{Nd}}+[.)]){S}+(.*)$"
NESTED_ITEM = rf"(?d)^{S}*(?:[-*+]|\p{{Nd}}+[.)]){S}+(.*)$"
TABLE_ROW = rf"^{S}{{0,3}}\|"
TABLE_RULE = rf"^{S}{{0,3}}\|?{S}*+:?-{{2,}}+:?{S}*+(?:\|{S}*+:?-{{2,}}+:?{S}*+)*+\|?{S}*+$"
TABLE_CELL = r"((?:`[^`]*`|[^|])++)"
#: A link, its text the first group; or brackets that are none, the second. A line is read up to its last closing parenthesis, so no place is looked at twice.
LINK = r"\[([^\]]*+)\]\([^)]*+\)|(\[[^\]]*+\]?+)"
CODE = r"`[^`]*`"

# Sentences and words.
SENTENCE_END = rf"(?<=[.!?:])(?={S}+[A-Z0-9\"'(])"
QUOTED = r"\"[^\"]*\""
PARENTHESES = r"\([^()]*\)"
NUMBER_UNIT = rf"(?=\p{{Nd}}){OPENS}\p{{Nd}}+(?:\.\p{{Nd}}+)?{S}?[a-zA-Z%]{{1,4}}{B}"
TITLE_RUN = rf"(?=[A-Z])(?<=[^{SPACE}]{S})[A-Z][a-zA-Z0-9]*(?:{S}+[A-Z][a-zA-Z0-9]*)++"

# Rules. Matches never hold a backtick, so a match inside a code span is seen as part of it.
# They look for a first letter before anything else, which rules out most places at once.
CONTRACTION = rf"(?iu){OPENS}{W}++'(?:t|s|re|ve|ll|d|m){CLOSES}"
PASSIVE = rf"(?iu)(?=[iawb]){OPENS}(?:is|are|was|were|be|being|(?<!(?:has|have|had){S}{{1,32}})been){S}+{W}+(?:ed|en){CLOSES}"
COMPLEX_VERB = rf"(?iu)(?=[hwcsm]){OPENS}(?:(?:has|have|had){S}+(?:been{S}+)?{W}+(?:ed|en)|(?:will|would|could|should|may|might|must){S}+have{S}+{W}+(?:ed|en)){CLOSES}"
#: Of a hyphenated run only the first part is tried as a beginning: where a later one could match, the first one does.
#: Letters are spelt out in both cases, with those that (?iu) takes for them; that is read faster than (?iu).
_AZ = "a-zA-Z\u0130\u0131\u017f\u212a"
ING_FORM = rf"(?=[{_AZ}]){OPENS}(?:(?<!-)|(?<=-)(?<!(?<!{W})[{_AZ}]{{1,24}}-{{1,2}}))[{_AZ}][{_AZ}-]{{2,}}[iI\u0130\u0131][nN][gG]{CLOSES}"
#: Words after which 's stands for "is" or "has". Fixed values.
IS_WORDS = ("it", "that", "this", "there", "here", "what", "who", "how", "when", "where", "why", "he", "she", "one", "everybody", "somebody", "nobody", "everyone", "someone", "no one", "let", "such")

TERM_TOKEN = rf"[{WORD}-]+"
NOT_IN_TERM = rf"(?<![{WORD}-])", rf"(?![{WORD}-])"


def quoted(text: str) -> str:
    """A literal text as a pattern."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def whole_term(term: str) -> str:
    """A term or phrase as a whole, any white space between its words, in either case."""
    before, after = NOT_IN_TERM
    return f"(?iu){before}" + f"{S}+".join(quoted(w) for w in term.split(" ")) + after


def whole_term_column(term: Column) -> Column:
    """``whole_term`` of a column of terms."""
    before, after = NOT_IN_TERM
    words = F.transform(F.split(term, " ", -1), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.concat(F.lit(f"(?iu){before}"), F.array_join(words, f"{S}+"), F.lit(after))


#: What (?iu) takes for a letter beside its two cases.
_MORE_CASES = {"i": "\u0130\u0131", "s": "\u017f", "k": "\u212a"}


def _either(c: str) -> str:
    """A character in either case; ASCII letters are spelt out, which is read faster than (?iu)."""
    if c.isascii() and c.isalpha():
        return f"[{c.lower()}{c.upper()}{_MORE_CASES.get(c.lower(), '')}]"
    return f"(?iu:{c if c.isalnum() else chr(92) + c})"


def any_of(words: list[str], in_either_case: bool = False) -> str:
    """An alternation of words that shares what they have in common from the left, so that each letter of a text is looked at once."""
    letter = _either if in_either_case else lambda c: "\\" + c if not c.isalnum() else c
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def shown(node: dict) -> str:
        parts = sorted(letter(c) + shown(below) for c, below in node.items() if c)
        ends = "" in node
        if not parts:
            return ""
        whole = parts[0] if len(parts) == 1 and not ends else f"(?:{'|'.join(parts)})"
        return f"{whole}?" if ends else whole

    return shown(tree)


def opens_any(words: list[str]) -> str:
    """A look ahead at the first letter of any of the words, which rules out most places at once."""
    firsts = {w[0] for w in words}
    return f"(?=[{''.join(sorted(_either(c)[1:-1] for c in firsts))}])" if all(c.isascii() and c.isalpha() for c in firsts) else ""
