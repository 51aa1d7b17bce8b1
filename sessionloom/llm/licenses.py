"""License scans by conditional compression.

Each template has cues: words of which any wording close enough to it must hold one. The words around
the cues, across line breaks, are a candidate block. A block is compressed plainly and with each license
template as a raw zstandard dictionary, and templates are ranked by what they save. In that order they are
held against the block word by word, which also says exactly where the wording differs; of templates that
are confirmed on one stretch, the one that saves most of it has it. The ranking is gone down to its end: a template is passed over only if the block lacks too many of its words in any order, which no
wording that is close enough does.
"""

from __future__ import annotations

import bisect
import difflib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import small_batches

# Short notices of public licenses, as authors put them into texts and files.
TEMPLATES = {
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
_WORD = re.compile(r"\w+(?:[.-]\w+)*")
#: Long words that ordinary prose is full of: the last to become cues.
COMMON = {"author", "authors", "commercial", "conditions", "following", "foundation", "international", "obtain", "obtaining", "person", "possible", "program", "provided", "public", "publish", "purpose", "related", "released", "source", "subject", "version", "without", "within"}
#: Words on each side of a cue that make its block, more where a given template is longer.
REACH = 60
#: Times that a window may grow.
GROWTHS = 8
CACHE_BLOCKS = 50_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(maxsize=4)
def cues(templates: tuple[tuple[str, str], ...], least_match: float) -> tuple[str, ...]:
    """Words one of which is in any stretch that holds ``least_match`` of a template's words in order.

    Such a stretch lacks so many of the template's places at most; the cues of a template cover one
    place more. Words are chosen one by one for the places they cover in all templates, long ones
    before short ones, which are common.
    """
    bags = [Counter(words_of(text)) for _, text in templates]
    open_ = [sum(bag.values()) - math.ceil(least_match * sum(bag.values()) - 1e-9) + 1 for bag in bags]
    chosen: list[str] = []
    while any(n > 0 for n in open_):
        gain: Counter = Counter()
        for bag, n in zip(bags, open_, strict=True):
            for word, times in bag.items():
                if n > 0 and word not in chosen:
                    gain[word] += min(times, n) * (0.1 if len(word) < 6 else 0.5 if word in COMMON else len(word) - 2)
        word = max(sorted(gain), key=gain.__getitem__)
        chosen.append(word)
        open_ = [n - bag[word] for bag, n in zip(bags, open_, strict=True)]
    return tuple(sorted(chosen))


def has_cue(text, wanted: tuple[str, ...]):
    """Whether a text holds a cue; of cues within each other only the shorter are looked for."""
    least = [cue for cue in wanted if not any(other != cue and other in cue for other in wanted)]
    # the text is put into lower case once, outside the alternatives
    return F.exists(F.array(F.lower(text)), lambda t: reduce(or_, [F.contains(t, F.lit(cue)) for cue in least], F.lit(False)))


@lru_cache(maxsize=4)
def cue_pattern(wanted: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(wanted, key=len, reverse=True))) + r")\b", re.I)


def _back(text: str, at: int, reach: int) -> int:
    """Where the ``reach`` words before ``at`` begin."""
    span = 12 * reach
    while True:
        low = max(0, at - span)
        before = [m.start() for m in _WORD.finditer(text, low, at)]
        if low == 0 or len(before) > reach:  # the first may be half a word
            return before[-reach] if len(before) > reach else 0
        span *= 2


def blocks(text: str, cue: re.Pattern, reach: int = REACH) -> Iterator[tuple[int, int]]:
    """Start and end of each candidate: the words around its cues, across line breaks.

    Each cue lies in a window that has ``reach`` words on both sides of it. A window grows while
    further cues lie in it; one that grows over many is cut, and the next one reaches back into it.
    """
    done = 0
    for found in cue.finditer(text):
        if found.start() < done:
            continue
        start, end = _back(text, found.start(), reach), found.end()
        for growth in range(GROWTHS + 1):
            after = [m.end() for m, _ in zip(_WORD.finditer(text, end), range(reach), strict=False)]
            reached = after[-1] if len(after) == reach else len(text)
            further = [m.end() for m in cue.finditer(text, end, reached)]
            if not further or growth == GROWTHS:
                break
            end = further[-1]
        done = end
        yield start, reached


@lru_cache(maxsize=1)
def _compressors(templates: tuple[tuple[str, str], ...]):
    import zstandard

    plain = zstandard.ZstdCompressor(level=9)
    own = {}
    for name, text in templates:
        words = " ".join(words_of(text))
        own[name] = (zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(words.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)), words.split(" "))
    return plain, own


def classify(block: str, templates: tuple[tuple[str, str], ...], *, least_match: float = 0.8) -> list[tuple]:
    """(license, saved, share, exact, differences, start, end, words) of the templates that a block holds.

    Templates come in the order of what they save of the block. One whose words a stretch of the block
    holds in order to ``least_match`` is confirmed there. Of those confirmed on one stretch, the one that
    saves most bytes of it has it, then the one that saves more of the block. ``saved``: share of the
    stretch's plain size that the template saves as a dictionary. ``differences`` tells each change of wording.
    """
    own = _compressors(templates)[1]
    words = [m for m in _WORD.finditer(block)]
    lower = [m[0].lower() for m in words]
    found: list[tuple] = []
    for name in ranked(" ".join(lower).encode(), templates):
        want = own[name][1]
        need, bag = least_match * len(want), Counter(want)
        rest: list = list(lower)
        left = Counter(w for w in rest if w in bag)
        while sum((bag & left).values()) >= need:
            # the stretch around the longest run in which the template would lie
            core = difflib.SequenceMatcher(None, want, rest, autojunk=False).find_longest_match()
            low, high = max(0, core.b - core.a - 3), min(len(lower), core.b + len(want) - core.a + 3)
            runs = [r for r in difflib.SequenceMatcher(None, want, lower[low:high], autojunk=False).get_matching_blocks() if r.size]
            same = sum(r.size for r in runs)
            if same < need:  # it may lie around another run
                left.subtract(rest[core.b : core.b + core.size])
                rest[core.b : core.b + core.size] = [None] * core.size
                continue
            first, last = low + runs[0].b, low + runs[-1].b + runs[-1].size
            changes = []
            for tag, a0, a1, b0, b1 in difflib.SequenceMatcher(None, want, lower[first:last], autojunk=False).get_opcodes():
                if tag != "equal":
                    changes.append(f"{' '.join(want[a0:a1])}->{' '.join(lower[first + b0 : first + b1])}")
            base, rest_size = _sizes(" ".join(lower[first:last]).encode(), name, templates)
            hit = (name, (base - rest_size) / base, same / len(want), not changes, "; ".join(changes), words[first].start(), words[last - 1].end(), same)
            found.append((base - rest_size, hit))
            break
    # the order of the sort is kept for equal savings: the block's ranking
    return sorted(taken([h for _, h in sorted(found, key=lambda x: -x[0])]), key=lambda h: h[5])


def taken(hits: list[tuple]) -> list[tuple]:
    """Those of ``hits`` that no hit before them overlaps."""
    kept: list[tuple] = []
    for hit in hits:
        if all(hit[6] <= h[5] or h[6] <= hit[5] for h in kept):
            kept.append(hit)
    return kept


def _sizes(data: bytes, name: str, templates: tuple[tuple[str, str], ...]) -> tuple[int, int]:
    """Compressed sizes plainly and with a template as a dictionary."""
    plain, own = _compressors(templates)
    return len(plain.compress(data)), len(own[name][0].compress(data))


def ranked(data: bytes, templates: tuple[tuple[str, str], ...]) -> list[str]:
    """All templates, those that save most of ``data`` first; of equal ones the longer, then by name."""
    plain, own = _compressors(templates)
    base = len(plain.compress(data))
    saved = {name: base - len(compressor.compress(data)) for name, (compressor, _) in own.items()}
    return sorted(own, key=lambda name: (-saved[name], -len(own[name][1]), name))


def apart(found: list[tuple]) -> list[tuple]:
    """Of findings that overlap the one that covers most words of its template, in order of place."""
    starts: list[int] = []
    kept: list[tuple] = []
    for hit in sorted(found, key=lambda h: (-h[7] * h[2], -h[1], h[0], h[5])):
        at = bisect.bisect_left(starts, hit[5])
        if (at == 0 or kept[at - 1][6] <= hit[5]) and (at == len(kept) or hit[6] <= kept[at][5]):
            starts.insert(at, hit[5])
            kept.insert(at, hit)
    return kept


def scan(docs: DataFrame, *, templates: dict[str, str] | None = None, least_match: float = 0.8) -> DataFrame:
    """One row per license found: doc_id, start, end (code points), license, saved, share, exact, differences.

    Whole texts are searched; only those without any cue of the templates are set aside before Python
    sees them, and no stretch that matches a template goes without one. A
    null or empty text has none; repeated rows give repeated findings; other columns are ignored; an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    fixed = tuple(sorted((templates or TEMPLATES).items()))
    reach = max(REACH, *(len(words_of(t)) + 6 for _, t in fixed))
    wanted = cues(fixed, least_match)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[tuple]] = {}
        cue = cue_pattern(wanted)

        def hits(block: str) -> list[tuple]:
            """All licenses of a block: what lies between those found is looked through again."""
            if block in cache:
                return cache[block]
            out, at = [], 0
            for hit in classify(block, fixed, least_match=least_match):
                out += [(*h[:5], at + h[5], at + h[6], h[7]) for h in (hits(block[at : hit[5]]) if cue.search(block, at, hit[5]) else [])]
                out.append(hit)
                at = hit[6]
            if at and cue.search(block, at):
                out += [(*h[:5], at + h[5], at + h[6], h[7]) for h in hits(block[at:])]
            if len(cache) >= CACHE_BLOCKS:
                cache.clear()
            if len(block) <= 10_000:
                cache[block] = out
            return out

        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                found = [(*h[:5], start + h[5], start + h[6], h[7]) for start, end in blocks(text, cue, reach) for h in hits(text[start:end])]
                # neighbouring windows overlap: what both hold counts once, where it is held whole
                rows += [(doc, h[5], h[6], *h[:5]) for h in apart(found)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "end", "license", "saved", "share", "exact", "differences"])

    return docs.select("doc_id", "text").filter(has_cue("text", wanted)).mapInArrow(task, f"doc_id {kind}, start long, end long, license string, saved double, share double, exact boolean, differences string")


def verdicts(docs: DataFrame, **options) -> DataFrame:
    """One row per document that holds licenses: doc_id, licenses (sorted, distinct), n_found, n_exact."""
    found = scan(docs, **options)
    return found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.count("*").alias("n_found"), F.sum(F.col("exact").cast("long")).alias("n_exact"))
