"""Splitting oversized items at natural boundaries.

Sizes are tokens. An item above the limit is split by a hierarchy of separators: sections, paragraphs and code blocks,
lines, sentences, words, and at last characters; a part that still is too long is split by the next kind. Code blocks
are told first, so that their comments are no headings and their blank lines no paragraphs. The parts are packed greedily into pieces up to the limit, and each piece after the first starts with the last tokens of the one
before it.

Defined cases: null and empty texts, and texts up to the limit, give no rows; a text without any boundary is cut between
tokens, if possible where a character starts. The text of a piece that starts within a character starts with the whole
of it; its ids are exact. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stemline.llm.bpe import VOCABULARY, Encoder, portions, shared, spread

LIMIT, OVERLAP = 1024, 64
#: Kinds of boundaries, the strongest first.
KINDS = ("section", "paragraph", "line", "sentence", "word", "character")
SECTION, PARAGRAPH, LINE, SENTENCE, WORD = range(5)
SENTENCE_END = regex.compile(r"[.!?…]+[\"'”’)\]]*(?=\s)|[。！？]+")
HEADING = regex.compile(r"[ ]{0,3}#{1,6}(?:[ \t]|$)")
UNDERLINE = regex.compile(r"[ ]{0,3}(?:-{2,}|={2,})[ \t]*$")
RULE = regex.compile(r"[ ]{0,3}(?:-{3,}|={3,}|\*{3,}|_{3,})[ \t]*$")
FENCE = regex.compile(r"[ ]{0,3}(`{3,}|~{3,})(.*)$")
CODE_TAG = regex.compile(r"<(/?)pre\b[^<>]*>|\[(/?)code\]", regex.IGNORECASE)
CODE_INDENT = regex.compile(r"(?:[ ]{4}|\t)[ \t]*\S")
PARAGRAPH_TAG = regex.compile(r"</p>[ \t]*$", regex.IGNORECASE)
END = "end"


def fenced(lines: list[str]) -> np.ndarray:
    """The number of the code block that each line belongs to, marks included, 0 outside; a fence that nothing closes is ordinary text.

    Blocks stand between fences, between pre or code tags, or are runs of indented lines behind a blank one.
    """
    block = np.zeros(len(lines), np.int64)
    fences = {i: (m[1][0], len(m[1]), not m[2].strip()) for i, x in enumerate(lines) if (m := FENCE.match(x)) and not (m[1][0] == "`" and "`" in m[2])}
    order, open_at, unclosed, count = list(fences), None, {}, 0
    k = 0
    while k < len(order):
        sign, width, _ = fences[order[k]]
        end = None
        if width < unclosed.get(sign, 1 << 60):  # a wider one that nothing closes says that this one is not closed either
            end = next((j for j in range(k + 1, len(order)) if fences[order[j]][2] and fences[order[j]][0] == sign and fences[order[j]][1] >= width), None)
        if end is None:
            unclosed[sign] = min(width, unclosed.get(sign, width))
            k += 1
        else:
            count += 1
            block[order[k] : order[end] + 1] = count
            k = end + 1
    for i, x in enumerate(lines):
        if block[i]:
            continue
        for m in CODE_TAG.finditer(x):
            closes, kind = bool(m[1] or m[2]), "pre" if m[0][1:5].lower().lstrip("/").startswith("pre") else "code"
            if not closes and open_at is None:
                open_at = (kind, i)
            elif closes and open_at and open_at[0] == kind:
                inside = block[open_at[1] : i + 1]
                count += 1
                inside[inside == 0] = count
                open_at = None
    indented, before = False, True
    for i, x in enumerate(lines):
        blank = not x.strip()
        if block[i]:
            indented, before = False, False
        elif CODE_INDENT.match(x) and (indented or before):
            count += not indented
            indented, before = True, False
            block[i] = count
        elif not blank:
            indented, before = False, False
        else:
            before = True
            if indented and i + 1 < len(lines) and not block[i + 1] and (CODE_INDENT.match(lines[i + 1]) or not lines[i + 1].strip()):
                block[i] = count  # a blank line within the run
            else:
                indented = False
    return block


def marks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(place, kind) of each boundary: the character in front of which a piece may start, in order, the strongest where several meet.

    A section starts at a heading, at the title above an underline, or at a rule. A paragraph starts behind blank lines, and
    a code block is one: nothing within it is a section, paragraph or sentence, only its lines are boundaries.
    """
    lines = text.split("\n")
    start = np.r_[0, np.cumsum([len(x) + 1 for x in lines])]
    block = fenced(lines)
    blank = np.array([not x.strip() for x in lines])
    kind = np.full(len(lines), LINE)
    changes = np.r_[False, block[1:] != block[:-1]]
    kind[changes] = PARAGRAPH
    inside = block > 0
    kind[np.r_[False, blank[:-1]] & ~blank & ~inside] = PARAGRAPH
    for i in np.flatnonzero(~inside & ~blank):
        x = lines[i]
        if HEADING.match(x):
            kind[i] = SECTION
        elif UNDERLINE.match(x) and i and not blank[i - 1] and not inside[i - 1] and not any(p.match(lines[i - 1]) for p in (HEADING, UNDERLINE, RULE)):
            kind[i - 1], kind[i] = SECTION, WORD  # the title and its line stay together
        elif RULE.match(x):
            kind[i] = SECTION
        elif PARAGRAPH_TAG.search(x) and i + 1 < len(lines) and kind[i + 1] > PARAGRAPH:
            kind[i + 1] = PARAGRAPH
    place, sort = start[1:-1], kind[1:]
    ends = np.array([m.end() for m in SENTENCE_END.finditer(text)], np.int64)
    if len(ends):
        ends = ends[~inside[np.searchsorted(start, ends - 1, side="right") - 1]]
        place, sort = np.r_[place, ends], np.r_[sort, np.full(len(ends), SENTENCE)]
    order = np.lexsort((sort, place))
    place, sort = place[order], sort[order]
    first = np.r_[True, place[1:] != place[:-1]] if len(place) else np.zeros(0, bool)
    return place[first], sort[first]


def boundaries(text: str, words: np.ndarray) -> np.ndarray:
    """The kind of the boundary behind each word (4 where only a word ends), from the character at which each word ends."""
    kind = np.full(len(words), WORD, np.int64)
    place, sort = marks(text)
    at = np.searchsorted(words, place, side="right") - 1  # a boundary within a word counts in front of it
    np.minimum.at(kind, at[at >= 0], sort[at >= 0])
    return kind


def parts(pos: np.ndarray, kind: np.ndarray, n: int, most: int, inner: np.ndarray) -> tuple[list[int], list[int]]:
    """Ends (in tokens) of parts of at most so many tokens, and the kind of each end. pos, kind: boundaries; inner: tokens that start inside a character."""
    ends: list[int] = []
    kinds: list[int] = []

    def split(lo: int, hi: int, level: int, end: int) -> None:
        if hi - lo <= most:
            ends.append(hi)
            kinds.append(end)
            return
        if level == 5:
            while hi - lo > most:
                cut = lo + most
                while cut > lo and inner[cut]:
                    cut -= 1
                lo = cut if cut > lo else lo + most
                ends.append(lo)
                kinds.append(5)
            ends.append(hi)
            kinds.append(end)
            return
        a, b = np.searchsorted(pos, [lo, hi], side="left")
        a += a < len(pos) and pos[a] == lo
        here = pos[a:b][kind[a:b] <= level]
        for cut in here.tolist():
            if cut > lo:
                split(lo, cut, level + 1, level)
                lo = cut
        split(lo, hi, level + 1, end)

    split(0, n, 0, -1)
    return ends, kinds


def pack(ends: list[int], kinds: list[int], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, kind of the end) of pieces in tokens, overlap included."""
    out, start, last = [], 0, 0
    for k, end in enumerate(ends):
        if end - start > limit:
            out.append((start, ends[last], kinds[last]))
            start = ends[last] - overlap
        last = k
    out.append((start, ends[-1], -1))
    return out


def split_oversized(
    docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text", contents: bool = True, path: str = VOCABULARY
) -> DataFrame:
    """(key, piece, start_token, n_tokens, ends_at[, text, ids]) of the pieces of texts above the limit; contents adds the last two."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    voc = shared(docs.sparkSession, path)
    kind_of_key = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind_of_key}, piece int, start_token int, n_tokens int, ends_at string" + ", text string, ids array<int>" * contents

    def run(batches):
        enc = Encoder(voc.value)
        out_schema = pa.schema([("k", pa.null())])
        for b in batches:
            names = [key, "piece", "start_token", "n_tokens", "ends_at", *["text", "ids"] * contents]
            out_schema = pa.schema([(key, b.schema.field(0).type), ("piece", pa.int32()), ("start_token", pa.int32()), ("n_tokens", pa.int32()), ("ends_at", pa.string()), *[("text", pa.string()), ("ids", pa.list_(pa.int32()))] * contents])
            for lo, hi in portions(b.column(1)):
                texts = b.column(1).slice(lo, hi - lo).to_pylist()
                word, count = enc.words(texts)
                ends = np.cumsum(count)
                rows: dict[str, list] = {c: [] for c in names}
                for i, t in enumerate(texts):
                    own = word[ends[i] - count[i] : ends[i]]
                    size = np.diff(enc.start)[own]
                    if size.sum() <= limit:
                        continue
                    total = np.r_[0, np.cumsum(size)]
                    ids = enc.flat[np.repeat(enc.start[own] - total[:-1], size) + np.arange(total[-1])]
                    chars = np.cumsum([len(w) for w in enc.split(t)])
                    e, k = parts(total[1:], boundaries(t, chars), len(ids), limit - overlap, voc.value.inner[ids])
                    raw = t.encode("utf-8", "surrogatepass") if contents else b""
                    at = np.r_[0, np.cumsum(voc.value.size[ids])]
                    for piece, (s, stop, kind) in enumerate(pack(e, k, limit, overlap)):
                        values = [b.column(0)[lo + i].as_py(), piece, s, stop - s, END if kind < 0 else KINDS[kind]]
                        if contents:
                            first = int(at[s])
                            while first and 0x80 <= raw[first] < 0xC0:
                                first -= 1
                            values += [raw[first : int(at[stop])].decode("utf-8", "ignore"), ids[s:stop]]
                        for c, x in zip(names, values):
                            rows[c].append(x)
                if rows[key]:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in out_schema], schema=out_schema)

    return spread(docs.select(key, text)).mapInArrow(run, schema)
