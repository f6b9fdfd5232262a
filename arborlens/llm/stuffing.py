"""Keyword-stuffed and link-list pages: characters covered by the repeated maximal substrings of a page's suffix automaton, where clauses are missing."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A phrase is a repeated substring of so many symbols (words, marks of links and hashtags) that occurs so often on the page.
PHRASE_WORDS, PHRASE_TIMES = 2, 3
#: Share of a line's characters that phrases must cover: of a line without clauses, of one that looks like code, and of one whose clauses repeat the dominant pair.
COVERED, COVERED_CODE, COVERED_CLAUSE = 0.25, 0.85, 0.5
#: A shorter line that looks like code is code.
LEAST_CODE = 8
#: A line of so many words without any clause is a list of tags where single words that occur KEYWORD_TIMES cover KEYWORDS of it.
LONG_LINE, KEYWORD_TIMES, KEYWORDS = 20, 2, 0.25
#: Words of the page's commonest pair against all its words, from which on sentences only repeat a keyword.
DOMINANT = 0.12
#: A page is stuffed where more than this share of its characters (blanks apart) is stuffing.
SHARE = 0.5

#: Beside sentences, fewer links than this are an ordinary page's links: their marks repeat nothing.
LEAST_LINKS = 6

#: Marks of links are symbols like words: the opening one, the closing one with its address, a bare address; so are the sign of a hashtag and a link to an issue,
#: commit, version or user, which makes its line an entry of a change log.
OPEN, CLOSE, ADDRESS, TAG, REFERENCE = "\x01\x02\x03\x04\x05"
MARKS = re.compile(r"""(\[(?:\#\d+|[0-9a-f]{7,40}|v?\d+(?:\.\d+)+|@[\w-]+|!\d+|pr\ \d+)\](?:\([^()\n]*\)))|(<a\s[^<>]*>|!?\[(?=[^\[\]\n]*\]\())|(</a>|\]\([^()\n]*\))|((?:https?://|www\.)[^\s<>"')\]]+)|((?<![\w&/])\#(?=[\w-]{3}))""")
MARK_OF = ("", REFERENCE, OPEN, CLOSE, ADDRESS, TAG)
SYMBOL = re.compile(r"[^\W_]+|[\x01-\x05]")
BLANK_MARKS = str.maketrans("".join(MARK_OF), "     ")
END = re.compile(r"[.!?](?=[\s\"')»*_`]|$)|[。！？]")
#: Signs and beginnings of lines of code, tables and listings.
SIGNS = re.compile(r"[{}=\\`$<>]|\(\)|\w\(|::|->|;\s*$|^\s*\|.*\|\s*$|^\s*[-*]?\s*\[[ x]\]|^\s*\.\.\. \(\d+ more\)")
HEADS = re.compile(r"^\s*(?:import|from|return|func|def|class|const|let|var|if|for|fi|done|set|echo|cd|package|type|use|end|else|then)\b|^\s*[\w.\"'-]+\s*[:=]\s*\S|^\s*[\w./-]+/\s*$|^\s*[\w.-]+\.\w{1,5}\s*$")


def repeated_lengths(symbols: Sequence[int], least_times: int) -> list[int]:
    """For each end position the length of the longest substring ending there that occurs at least `least_times`; from the suffix automaton, whose states
    stand for the maximal substrings with one set of ends."""
    follow: list[dict[int, int]] = [{}]
    link, length, times, at = [-1], [0], [0], []
    last = 0
    for s in symbols:
        new = len(length)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        times.append(1)
        p = last
        while p >= 0 and s not in follow[p]:
            follow[p][s] = new
            p = link[p]
        if p >= 0:
            q = follow[p][s]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(length)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                times.append(0)
                while p >= 0 and follow[p].get(s) == q:
                    follow[p][s] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
        at.append(new)
    order = sorted(range(1, len(length)), key=length.__getitem__)
    for v in reversed(order):
        if link[v] > 0:
            times[link[v]] += times[v]
    best = [0] * len(length)
    for v in order:
        best[v] = length[v] if times[v] >= least_times else best[link[v]]
    return [best[v] for v in at]


def repeats(symbols: Sequence[Hashable], least: int, times: int, lengths: Callable[[Sequence[int], int], list[int]] = repeated_lengths) -> list[bool]:
    """Which symbols lie in a substring of at least `least` (one or two) symbols that occurs at least `times`.

    Every symbol of such a substring, and every pair of neighbours in it, occurs as often itself. So a stretch without such pairs (symbols, for `least` = 1) can't be part of
    one and enters the automaton as a single symbol of its own, which changes no answer.
    """
    inside = bytearray(len(symbols))
    if least > 1:
        pairs = Counter(zip(symbols, symbols[1:]))
        for i, pair in enumerate(zip(symbols, symbols[1:])):
            if pairs[pair] >= times:
                inside[i] = inside[i + 1] = 1
    else:
        counts = Counter(symbols)
        for i, s in enumerate(symbols):
            inside[i] = counts[s] >= times
    number: dict[Hashable, int] = {}
    stream, where = [], []
    for i, s in enumerate(symbols):
        if inside[i]:
            stream.append(number.setdefault(s, len(number)))
            where.append(i)
        elif where and where[-1] >= 0:
            stream.append(-1 - i)
            where.append(-1)
    longest = lengths(stream, times)
    covered = [False] * len(symbols)
    left = 0
    for k in range(len(stream) - 1, -1, -1):
        left = max(left - 1, longest[k] if longest[k] >= least else 0)
        if left > 0:
            covered[where[k]] = True
    return covered


def marked(text: str) -> tuple[str, list[int]]:
    """`text` in lower case with a single character for each mark of a link or hashtag, and the marks' lengths."""
    low = text.lower()
    if not low.isprintable() and any(c in low for c in MARK_OF[1:]):
        low = low.translate(BLANK_MARKS)
    sizes: list[int] = []
    if "#" not in low and "](" not in low and "://" not in low and "www." not in low and "<a" not in low:
        return low, sizes

    def mark(m: re.Match) -> str:
        sizes.append(len(m[0]))
        return MARK_OF[m.lastindex]

    return MARKS.sub(mark, low), sizes


def solid(text: str) -> int:
    return len("".join(text.split()))


def clauses(text: str) -> int:
    """Stretches that end like a sentence and have the words of one."""
    n, last = 0, 0
    for m in END.finditer(text):
        part = text[last : m.start()]
        n += len(part.strip()) >= 6 if m.group() in "。！？" else len(part.split()) >= 5
        last = m.end()
    return n


def stuffing(text: str | None, lengths: Callable[[Sequence[int], int], list[int]] = repeated_lengths) -> tuple[int, int]:
    """(characters of stuffing, characters), blanks apart. Coverage is measured over the page, clauses and code are looked for line by line. A line is stuffing

    * without clauses, where repeated phrases (links are phrases of their marks and words) cover `COVERED` of it, or `COVERED_CODE` where it also looks
      like code, a table or a listing and a single pair of words dominates the page;
    * without clauses and `LONG_LINE` words long, where repeated keywords cover `KEYWORDS` of it;
    * with clauses, where a single pair of words dominates the page and phrases cover `COVERED_CLAUSE` of the line.

    Entries of change logs are none. Null, empty and blank texts are (0, 0).
    """
    if not text or text.isspace():
        return 0, 0
    low, sizes = marked(text)
    lines = low.split("\n")
    parts = [SYMBOL.findall(line) for line in lines]
    names = [s for part in parts for s in part]
    length = list(map(len, names))
    if sizes:
        few = sum(map(names.count, (OPEN, ADDRESS))) < LEAST_LINKS and clauses(low.translate(BLANK_MARKS)) > 0
        places = [i for i, s in enumerate(names) if s <= REFERENCE]
        for i, size in zip(places, sizes):
            length[i] = size
            if few and names[i] != TAG:
                names[i] += str(i)
    often = max(Counter(zip(names, names[1:])).values(), default=0)
    dominant = often * 2 >= DOMINANT * len(names)
    # without such a pair there is no phrase
    phrases = weighed(repeats(names, PHRASE_WORDS, PHRASE_TIMES, lengths), length) if often >= PHRASE_TIMES else None
    keywords: list[int] | None = None
    total = solid(text)
    stuffed, k = 0, 0
    fences = [i for i, line in enumerate(lines) if line.lstrip().startswith(("```", "~~~"))] if "```" in low or "~~~" in low else []
    code = {i for a, b in zip(fences[::2], fences[1::2]) for i in range(a, b + 1)}  # a fence that is never closed is none
    for i, (line, part) in enumerate(zip(lines, parts)):
        first, k = k, k + len(part)
        if k == first or i in code or REFERENCE in part:
            continue
        chars = sum(length[first:k])
        share = sum(phrases[first:k]) / chars if phrases else 0.0
        if share < COVERED and len(part) < LONG_LINE:
            continue
        # marks of links are no text: they neither end clauses nor look like code
        plain = line.translate(BLANK_MARKS) if sizes else line
        if clauses(plain):
            hit = dominant and share > COVERED_CLAUSE
        else:
            coded = SIGNS.search(plain) is not None
            hit = share >= COVERED and (not (coded or HEADS.search(plain)) or dominant and share >= COVERED_CODE and len(part) >= LEAST_CODE)
            if not hit and len(part) >= LONG_LINE and not coded:
                keywords = keywords or weighed(repeats(names, 1, KEYWORD_TIMES, lengths), length)
                hit = sum(keywords[first:k]) >= KEYWORDS * chars
        if hit:
            stuffed += solid(plain) + sum(n for s, n in zip(names[first:k], length[first:k]) if s[0] <= REFERENCE)
    return min(stuffed, total), total


def weighed(covered: list[bool], length: list[int]) -> list[int]:
    return [n if c else 0 for n, c in zip(length, covered)]


def stuffed_pages(df: DataFrame, row_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """Rows (row_id, stuffed_chars, chars) of the pages of which more than `share` is stuffing (see `stuffing`). Null, empty and blank texts are no such pages; texts
    are read whole; repeated rows come out repeated; other columns are not read. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, total = stuffing(t)
                if n > share * total:
                    rows.append((i, n, total))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["id", "stuffed_chars", "chars"])

    return df.select(F.col(row_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, "id bigint, stuffed_chars bigint, chars bigint").withColumnRenamed("id", row_id)
