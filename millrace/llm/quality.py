"""Problem 1: statistics of each text, and what most of it is if not running text.

A text's lines fall into stretches, and each stretch is judged by three
features of its structure together with ratios of words, signs and punctuation:

* vertical alignment: how many of its lines hold one delimiter as many times as
  most of them do;
* indentation periodicity: how often the way a line is led in (its indentation
  and its mark, such as a bullet, a number or a box) comes back at a fixed
  distance; for programs, how many lines keep to the steps of one indentation;
* line-length autocorrelation: how alike the lengths of lines are at the best
  distance of one to four lines (without subtracting the mean, so that equal
  lengths give 1).

Each kind has a sum of weighted evidence (``table_evidence``, ``list_evidence``,
``code_evidence``) and a least sum. Source code is no case. What is left is junk
by its letters, by endless repetition, or by words in a row without any
sentence; no list of words of any language takes part in that. The kind that
holds most of the characters decides.

Defined results: a null text has null statistics, an empty or blank one zeros,
and neither has a ``body``; repeated rows are repeated.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.texts import map_texts

#: Small words that bind sentences, by language.
COMMON = {
    "en": "the of and to a in is was that it for on with as this be by are not but from they which an you what when than had if she he".split(),
    "de": "der die das und in ist zu den mit von nicht ein eine hat auf dem wird sich es".split(),
    "fr": "le la les de des et à un une est que qui dans pour pas ne on il du au en".split(),
    "es": "el la los de y en que un una es no se por con para del al ni su".split(),
    "pt": "o a os as de e em que um uma não se da do com para por no na nem".split(),
    "hi": "के का की में से को है और पर नहीं कि ने हैं था भी हो ही यह".split(),
    "mr": "आणि आहे च्या ची चे ला ने मध्ये नाही की हे या शी पण होते तरी".split(),
    "bn": "এর ও না এবং থেকে জন্য সালে কি যে এই করে হয় ছিল আর কথা".split(),
    "ta": "மற்றும் என்று இல்லை ஒரு பற்றி அது இந்த என்ன மட்டுமே இல்லாமல் முன் எந்த ஆகும் இடத்தைப்".split(),
}
_COMMON = frozenset(w for ws in COMMON.values() for w in ws)

#: Combining marks and the joiners, and the letters of the Indic blocks (not their digits and dandas), as first and last code points.
_MARKS = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x300, 0x36F), (0x900, 0x963), (0x970, 0x9E5), (0x9F0, 0xA65), (0xA70, 0xB65), (0xB70, 0xBE5), (0xBF0, 0xDFF), (0x200C, 0x200D)))
_WORD = re.compile(f"[^\\W\\d_]+(?:['’]?[{_MARKS}]*[^\\W\\d_]*)*")
_BREAKS = re.compile(r"<(?:/?(?:p|br|div|h\d|li|tr|ul|ol|table|thead|tbody|html|body|head|title)\b)[^<>]*>", re.I)
_CELLS = re.compile(r"</t[dh]>\s*<t[dh][^<>]*>", re.I)
_TAGS = re.compile(r"<[/!]?[A-Za-z][^<>]*>")
#: What leads an item in: its indentation and its mark.
_LEAD = re.compile(r"([ \t]*)((?:[-–—*•·▪◦‣+]|\[[ xX]\]|\(?(?:\d{1,3}|[A-Za-z])[.)]|\d{1,3} [-–]|[०-९০-৯]{1,3}[.)])\s+)?")
_SENTENCE_END = ".!?।॥…:;\"'”’»)"
_STOPS = ".!?।॥…"
_INNER = re.compile("[.!?।…]\\s")
#: Signs of statements, whatever the language: calls, assignments, brackets and separators at the end, a key with one value.
_STATEMENT = re.compile(r"[\w)\]]\(|\w\[|(?:^|[^=<>!])=(?:[^=]|$)|[=!<>+*/-]=|->|=>|::|\|\||&&|\$[\w{(]|[{}(\[;]\s*$|\)[;,:]?\s*$|^\s*[@#]\S|^\s*(?:#|//|--|/\*) |^\s*[\w-]+:\s*[\w./'\"-]*$|^\s*[})\]]")
#: Characters one of which every such sign has.
_SIGN = re.compile(r"[]()\[={}<>;:|&$@#*/+-]")
_FORMULA = re.compile(r"\d\s*[-+*/=×÷]\s*\d|\d[a-z]\s*[-+=]")
_ODD = re.compile(r"[~^$#|\\&@%_<>]")
_SPACES = re.compile(r"(?<=\S) {2,}(?=\S)")
_RULE = re.compile(r"^[\s|:+=-]+$")
_VOWEL = re.compile("[aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ]", re.I)
_CASED = re.compile(r"(?:^|[.!?…]\s)[\s\"'“”‘’«»¿¡(]*([^\W\d_])")
#: Characters that UTF-8 read as another encoding turns into.
_MOJIBAKE = re.compile("[" + "".join(map(chr, (0xA2, 0xA8, 0xA9, 0xAB, 0xAC, 0xBB, 0xBD, 0xBF, 0xC2, 0xC3, 0xE2, 0xEF, 0x153, 0x201A, 0x201C, 0x201E, 0x20AC, 0x2122, 0xFFFD))) + "]")
#: Marks that part the items of a list written in one line, the strongest first.
_PARTS = (" · ", " | ", " » ", " • ", " / ", "; ", ", ")
#: Delimiters of cells, and how much each speaks for a table by itself.
MARKS = {"\t": 0.5, "|": 0.4, "  ": 0.3, ";": 0.1, ",": 0.0}

LEAST_ITEMS, LEAST_ROWS = 4, 3
#: Words of a line from which on it is no item: without and with a mark that leads it in.
ITEM_WORDS_MOST, MARKED_WORDS_MOST = 9, 18
LEAST_TABLE, LEAST_LIST, LEAST_CODE = 1.9, 1.2, 0.5
#: A line is a statement if it holds a sign of one for each so many characters.
SIGN_EVERY = 80
#: Words in a row are no text if fewer than this share of them are short and fewer than half of what begins sentences is capital.
SHORT_WORD, LEAST_SHORT = 3, 0.08

STATS = [
    ("n_chars", T.LongType()),
    ("n_words", T.LongType()),
    ("mean_word_length", T.DoubleType()),
    ("symbol_ratio", T.DoubleType()),
    ("punct_line_share", T.DoubleType()),
    ("common_word_share", T.DoubleType()),
    ("delimiter_alignment", T.DoubleType()),
    ("indent_periodicity", T.DoubleType()),
    ("line_length_autocorrelation", T.DoubleType()),
    ("running_share", T.DoubleType()),
    ("list_share", T.DoubleType()),
    ("table_share", T.DoubleType()),
    ("junk_share", T.DoubleType()),
    ("code_share", T.DoubleType()),
    ("body", T.StringType()),
]


def plain_lines(text: str) -> list[str]:
    """The text's lines, with block markup as line breaks and cells as tabs."""
    if "<" in text:
        text = _TAGS.sub("", _BREAKS.sub("\n", _CELLS.sub("\t", text)))
    return text.replace(chr(0xA0), " ").replace(chr(0x200B), "").replace("\r\n", "\n").replace("\r", "\n").split("\n")


# ---------------------------------------------------------------- features of structure


def alignment(counts: list[int]) -> float:
    """The share of lines that hold a delimiter as many times as most of the lines do."""
    held = Counter(c for c in counts if c)
    return max(held.values()) / len(counts) if held else 0.0


def periodicity(leads: list[tuple[int, str]]) -> float:
    """The largest share, over distances of one to four lines, of lines led in by a mark or an indentation as the line at that distance is."""
    n = len(leads)
    best = 0.0
    for k in range(1, min(5, n)):
        best = max(best, sum(a == b and a != (0, "") for a, b in zip(leads, leads[k:])) / (n - k))
    return best


def stepping(indents: list[int]) -> float:
    """The share of lines indented deeper than the least by whole steps of one width."""
    least = min(indents, default=0)
    deeper = [i - least for i in indents if i > least]
    if not deeper:
        return 0.0
    step = min(deeper)
    return sum(i % step == 0 for i in deeper) / len(indents)


def autocorrelation(lengths: list[int]) -> float:
    """The largest correlation, not centred, of line lengths with those one to four lines on; 1 for equal lengths, 0 for fewer than three lines."""
    if len(lengths) < 3:
        return 0.0
    x = np.array(lengths, float)
    found = 0.0
    for k in range(1, min(5, len(x) - 1)):
        power = float((x[k:] ** 2).sum() * (x[:-k] ** 2).sum()) ** 0.5
        found = max(found, float((x[k:] * x[:-k]).sum()) / power if power else 0.0)
    return found


def lead_of(line: str) -> tuple[tuple[int, str], str]:
    """How a line is led in (its indentation and the kind of its mark), and the rest of it."""
    m = _LEAD.match(line)
    mark = (m.group(2) or "").strip()
    kind = "1" if mark[:1].isdigit() or mark[1:2].isdigit() else "a" if mark[:1].isalpha() else mark[:1]
    return (len(m.group(1)), kind), line[m.end() :].strip()


# ---------------------------------------------------------------- evidence


def table_evidence(lines: list[str], counts: list[int], mark: str) -> float:
    """What speaks for rows of cells: aligned delimiters, lines of like length, numbers, a delimiter of tables, short cells and no ends of sentences."""
    solid = sum(map(len, lines))
    digits = sum(sum(map(x.count, "0123456789")) for x in lines)
    ended = sum(x[-1] in _STOPS for x in lines) / len(lines)
    wordy = sum(len(x.replace(mark, " ").split()) for x in lines) / max(1, sum(counts) + len(lines))
    return 1.5 * alignment(counts) + 0.8 * autocorrelation([len(x) for x in lines]) + 0.4 * min(1.0, 2 * digits / solid) + MARKS[mark] - 1.2 * ended - 0.25 * wordy


def list_evidence(items: list[str], leads: list[tuple[int, str]]) -> float:
    """What speaks for items: few words, lines led in alike, lines of like length, and neither ends of sentences nor sentences within."""
    n = len(items)
    if n < LEAST_ITEMS:
        return 0.0
    sizes = sorted(len(x.split()) for x in items)
    short = min(1.0, max(0.0, (ITEM_WORDS_MOST - sizes[n // 2]) / 4))
    long = sum(len(x.split()) > (MARKED_WORDS_MOST if mark else ITEM_WORDS_MOST) for x, (_, mark) in zip(items, leads)) / n
    ended = sum(x[-1:] in _STOPS or x[-1:] == "," for x in items) / n
    inner = sum(bool(_INNER.search(x)) for x in items) / n
    return short + periodicity(leads) + 0.6 * autocorrelation([len(x) for x in items]) - 1.5 * ended - 2.0 * inner - 2.0 * long


def code_evidence(lines: list[str]) -> tuple[float, float]:
    """What speaks for a program, and the share of its characters in statements: signs of statements and lines that keep to steps of one indentation, no ends of sentences."""
    whole = sum(map(len, lines))
    share = sum(len(x) for x in lines if len(_SIGN.findall(x)) * SIGN_EVERY >= len(x) and len(_STATEMENT.findall(x)) * SIGN_EVERY >= len(x)) / whole
    ended = sum(x.rstrip()[-1] in ".!?।…" for x in lines) / len(lines)
    return 0.8 * share + 0.6 * stepping([len(x) - len(x.lstrip(" \t")) for x in lines]) - 1.0 * ended, share


def tables(lines: list[str]) -> tuple[list[bool], float]:
    """Which lines are rows of a table, and the best alignment met.

    Lines in a row that hold a delimiter are a stretch; rules between rows belong to it.
    """
    inside, aligned = [False] * len(lines), 0.0
    bare = [x.strip() for x in lines]
    for mark in MARKS:
        if not any(mark in x for x in bare):
            continue
        if mark == "  ":
            counts = [len(_SPACES.findall(x)) if mark in x else 0 for x in bare]
        else:
            counts = [x.strip(mark + " ").count(mark) for x in bare]
        rule = [c > 0 and bool(_RULE.match(x)) for x, c in zip(bare, counts)]
        start = 0
        while start < len(lines):
            if not counts[start]:
                start += 1
                continue
            end = start
            while end < len(lines) and counts[end]:
                end += 1
            rows = [k for k in range(start, end) if not rule[k] and not inside[k]]
            if len(rows) >= LEAST_ROWS:
                own = [counts[k] for k in rows]
                aligned = max(aligned, alignment(own) * len(rows) / len(lines))
                if table_evidence([bare[k] for k in rows], own, mark) >= LEAST_TABLE:
                    inside[start:end] = [True] * (end - start)
            start = end
    return inside, aligned


def one_line_items(line: str) -> bool:
    """Whether a line is a list by itself: parts between one repeated mark, judged as lines are."""
    for mark in _PARTS:
        if line.count(mark) >= LEAST_ITEMS:
            parts = [p.strip() for p in line.strip(" .").split(mark)]
            # A comma parts clauses too, so it does not count as what leads items in, and its items must be the shorter.
            weak = mark == ", "
            if weak and sum(len(p.split()) for p in parts) > 4 * len(parts):
                continue
            if list_evidence(parts, [(0, "" if weak else mark)] * len(parts)) >= LEAST_LIST:
                return True
    return False


def is_gibberish(words: list[str], text: str, letters: int, signs: int) -> bool:
    """Junk by its letters: hardly any, unpronounceable words, blocks without spaces, wrong decoding."""
    solid = letters + signs
    if not solid:
        return False
    if letters < 0.45 * solid and (len(_ODD.findall(text)) > 0.15 * solid or not _FORMULA.search(text)):
        return True
    if len(_MOJIBAKE.findall(text)) > 0.6 * solid:
        return True
    latin = [w for w in words if w.isascii()]
    size = sum(map(len, latin))
    # Half of the words must have next to no vowels before each is looked at.
    if size > 0.5 * letters and len(latin) >= 5 and len(_VOWEL.findall(" ".join(latin))) * 4 < size:
        mute = sum(len(w) for w in latin if len(w) > 2 and len(_VOWEL.findall(w)) * 6 < len(w))
        if mute > 0.4 * size:
            return True
    longest = max(map(len, text.split()), default=0)
    return longest > 60 and longest > 0.5 * solid


def is_salad(words: list[str], lines: list[str], letters: int) -> bool:
    """Junk by its words, in scripts with capitals: many, hardly any short ones, and no sentences that begin with a capital."""
    if len(words) < 15 or 2 * sum(len(w) for w in words if w.isascii()) <= letters:
        return False
    if sum(len(w) <= SHORT_WORD for w in words) >= LEAST_SHORT * len(words):
        return False
    begun = [c for x in lines for c in _CASED.findall(x)]
    return 2 * sum(c.isupper() for c in begun) < len(begun)


def is_repeated(words: list[str]) -> bool:
    return len(words) >= 8 and (n := len(set(words))) <= 12 and 6 * n <= len(words)


def describe(text: str | None) -> tuple:
    """The values of STATS for one text."""
    if text is None:
        return (None,) * len(STATS)
    stripped = text.strip()
    if not stripped:
        return (len(text), 0, *(0.0,) * 12, None)
    lines = [x for x in plain_lines(text) if x.strip()] or [stripped]
    body = "\n".join(lines)
    words = _WORD.findall(body)
    lowered = [w.lower() for w in words]
    letters = sum(map(len, words))
    solid = len("".join(body.split()))
    digits = sum(map(body.count, "0123456789"))
    signs = max(0, solid - letters - digits)
    common = sum(w in _COMMON for w in lowered)
    ends = sum(x.rstrip()[-1] in _SENTENCE_END for x in lines)
    whole = sum(map(len, lines))

    coded, code_share = code_evidence(lines)
    is_code = coded >= LEAST_CODE and letters > 0.35 * solid
    rows, aligned = tables(lines)
    told = [lead_of(x) for x in lines]
    leads = [lead for lead, _ in told]
    shares = Counter()
    run: list[int] = []

    def close() -> None:
        is_list = list_evidence([told[k][1] for k in run], [leads[k] for k in run]) >= LEAST_LIST
        shares["list" if is_list else "running"] += sum(len(lines[k]) for k in run)
        run.clear()

    for k, (x, (lead, bare)) in enumerate(zip(lines, told)):
        if rows[k]:
            close()
            shares["table"] += len(x)
            continue
        n = len(bare.split())
        if bare and n <= (MARKED_WORDS_MOST if lead[1] else ITEM_WORDS_MOST) and not (n > 3 and bare[-1] in _STOPS):
            run.append(k)
            continue
        close()
        shares["list" if one_line_items(x) else "running"] += len(x)
    close()
    running, listed, tabled = (shares[k] / whole for k in ("running", "list", "table"))

    junk = 0.0
    if not is_code and tabled <= 0.5:
        if is_gibberish(words, body, letters, signs + digits) or (listed <= 0.5 and (is_salad(words, lines, letters) or is_repeated(lowered))):
            junk, running, listed, tabled = 1.0, 0.0, 0.0, 0.0
    kind = None
    if not is_code:
        kind = "junk" if junk > 0.5 else ("table" if tabled >= listed else "list") if tabled + listed > 0.5 else None
    return (
        len(text),
        len(words),
        letters / len(words) if words else 0.0,
        signs / solid if solid else 0.0,
        ends / len(lines),
        common / len(words) if words else 0.0,
        aligned,
        max(periodicity(leads), stepping([indent for indent, _ in leads])),
        autocorrelation([len(x) for x in lines]),
        running,
        listed,
        tabled,
        junk,
        code_share,
        kind,
    )


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the columns of STATS for each row of ``df``."""
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType)] + [T.StructField(n, t) for n, t in STATS])

    def make():
        def act(keys: list, texts: list) -> list:
            return [keys, *map(list, zip(*(describe(t) for t in texts)))]

        return act

    return map_texts(df, [id_col, text_col], text_col, out, make)
