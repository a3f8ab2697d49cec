"""License scan by a positional rare-token index, with DataFrame functions only.

Entries are short word sequences of two kinds: phrases, of which every word must
stand in place, and notices, of which a share of the rarest words must. A word's
rarity is its inverse document frequency over the notices. The index maps a
word to postings (entry, place in the entry), by a constant hash table. A file's licence words vote, for
each posting, for the position where the entry would begin; an entry is found
where enough votes agree. A notice counts only if its mandatory key phrase is
found too.

A base phrase, or a key phrase that a notice rests on, can't be found in a file that lacks
one of its words, so files that lack a word of each are passed over, which loses
nothing. The index is a constant of a few hundred words; nothing is
shuffled or joined, and no text leaves its row.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.

Defined cases: a null text counts as empty and has 0 words; phrases that overlap
count each; labels are distinct and sorted; without base phrases first_word and
last_word are null. Repeated rows are scanned alike; a text is read whole, whatever its length; an empty
table gives an empty one; other columns pass through, but for those that have the names of the results.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import cached_property, reduce
from string import ascii_lowercase, ascii_uppercase

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between the words, before A-Z are lower-cased; cutting at it costs an eighth of matching the words.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Words of well-known licence texts and notices, label, and the key phrase each must hold.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", "free of charge to any person obtaining a copy"),
    ("released under the mit license", "mit", "under the mit license"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2.0", "apache license version 2 0"),
    ("licensed under the apache license version 2 0", "apache-2.0", "apache license version 2 0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl", "gnu general public license"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", "gnu general public license version 3"),
    ("under the terms of the gnu lesser general public license", "lgpl", "gnu lesser general public license"),
    ("under the terms of the gnu affero general public license", "agpl", "gnu affero general public license"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", "with or without modification are permitted"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", "with or without fee is hereby granted"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", "mozilla public license"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "released into the public domain"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", "cc by nc 4 0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", "cc by sa 4 0"),
    ("licensed under cc by 4 0", "cc-by-4.0", "cc by 4 0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0", "creative commons attribution 4 0"),
    ("to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", "mit", "sublicense and or sell copies of the software"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", "all copies or substantial portions of the software"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice", "bsd", "redistributions of source code must retain the above copyright notice"),
    ("may be used to endorse or promote products derived from this software without specific prior written permission", "bsd", "endorse or promote products derived from this software"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib", "without any express or implied warranty"),
    ("the origin of this software must not be misrepresented you must not claim that you wrote the original software", "zlib", "must not be misrepresented"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "bsl-1.0", "accompanying documentation covered by this license"),
    ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unlicense", "as a compiled binary for any purpose"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2.0", "without warranties or conditions of any kind"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gpl", "distributed in the hope that it will be useful"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl", "gnu lesser general public license"),
    ("if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2.0", "copy of the mpl was not distributed with this file"),
    ("everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "gpl", "copy and distribute verbatim copies of this license document"),
    ("the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "cc0-1.0", "dedicated the work to the public domain"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl", "eclipse public license"),
    ("you just do what the fuck you want to", "wtfpl", "do what the fuck you want to"),
)

RARE_WORDS = 8
SHARE = 0.75
_PLACE = 1 << 40
_SHIFT = 1 << 12  # an entry may begin before a file's first word


@dataclass(frozen=True)
class Entry:
    label: str
    words: tuple[tuple[str, int], ...]
    need: int
    length: int
    key: int | None = None


class Index:
    """Entries: base phrases first, then key phrases, then notices."""

    def __init__(self, base=BASE, notices=NOTICES, rare_words: int = RARE_WORDS, share: float = SHARE):
        texts = [n.split() for n, _, _ in notices]
        often = Counter(w for t in texts for w in set(t))
        self.idf = {w: math.log((1 + len(texts)) / (1 + n)) for w, n in often.items()}
        # Of words that are as rare here, longer ones are rarer elsewhere.
        rarity = lambda w: (-self.idf.get(w, math.log(1 + len(texts))), -len(w), w)
        whole = lambda text, label: Entry(label, tuple((w, k) for k, w in enumerate(text.split())), len(text.split()), len(text.split()))
        self.base = len(base)
        self.entries = [whole(text, label) for text, label in base]
        at = {}
        for _, _, key in notices:
            if key not in at:
                at[key] = len(self.entries)
                self.entries.append(whole(key, ""))
        self.notices = len(self.entries)
        for (_, label, key), words in zip(notices, texts, strict=True):
            rarest = sorted(sorted(range(len(words)), key=lambda k: (rarity(words[k]), k))[:rare_words])
            picked = tuple((words[k], k) for k in rarest)
            self.entries.append(Entry(label, picked, math.ceil(share * len(picked)), len(words), at[key]))
        # Every finding rests on a base or key phrase, all words of which must stand in the text; the rarest first.
        self.phrases = [tuple(sorted({w for w, _ in e.words}, key=rarity)) for e in self.entries[: self.notices]]
        self.anchors = sorted({words[0] for words in self.phrases})
        # (word, other words of each phrase that has it): one word rules out many phrases at once.
        self.gates, left = [], list(self.phrases)
        while left:
            often = Counter(w for p in left for w in p if len(w) >= 6) or Counter(p[0] for p in left)
            word = max(often, key=lambda w: (often[w], len(w), w))
            mine = [p for p in left if word in p]
            self.gates.append((word, [[w for w in p if w != word] for p in mine]))
            left = [p for p in left if word not in p]

    @cached_property
    def postings(self) -> dict[str, list[int]]:
        """By word: entry * 2**40 - place, so that adding a position gives a vote."""
        found: dict[str, list[int]] = {}
        for e, entry in enumerate(self.entries):
            for w, k in entry.words:
                found.setdefault(w, []).append(e * _PLACE + _SHIFT - k)
        return found


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _GAP, -1), lambda w: w != "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _lookup(postings: dict[str, list[int]]):
    """Function from a word to its postings: a constant hash table, an array of slots that
    hold the few words of one hash, so a lookup costs the same for any number of words."""
    size = 1 << max(6, (4 * len(postings)).bit_length())
    slots: list[list[str]] = [[] for _ in range(size)]
    for w in sorted(postings):
        slots[xxhash.xxh64_intdigest(w.encode(), seed=42) % size].append(w)
    longs = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values])
    row = lambda w: F.struct(F.lit(w).alias("word"), longs(postings[w]).alias("at"))
    kind = "array<struct<word:string,at:array<bigint>>>"
    table = F.array(*[F.array(*[row(w) for w in slot]).cast(kind) for slot in slots])
    return lambda w: F.flatten(F.transform(F.filter(F.get(table, F.xxhash64(w).bitwiseAND(F.lit(size - 1)).cast("int")), lambda x: x["word"] == w), lambda x: x["at"]))


def with_licenses(docs: DataFrame, index: Index | None = None, text: str = "text") -> DataFrame:
    """``docs`` with n_words, found (array of entry, word, label), and the summary columns.
    Columns of these names are replaced; the row travels as one column until then."""
    index = index or Index()
    lists = _lookup(index.postings)
    need = F.array(*[F.lit(e.need) for e in index.entries])
    key = F.array(*[F.lit(-1 if e.key is None else e.key) for e in index.entries])
    label = _strings(e.label for e in index.entries)
    none = F.array().cast("array<bigint>")
    entry = lambda v: F.floor(v / _PLACE).cast("int")

    body = F.coalesce(F.col("row")[text], F.lit(""))
    low = F.lower(body)  # folds more letters than A-Z, which can only let more texts through
    has = lambda words: reduce(lambda a, w: a & F.col("low").contains(w), words, F.lit(True))
    any_of = reduce(lambda a, g: a | (has([g[0]]) & reduce(lambda x, p: x | has(p), g[1], F.lit(False))), index.gates, F.lit(False))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("low", low).withColumn("may", any_of).drop("low")
    # Case only matters where an entry may be found.
    df = df.withColumn("words", _words(F.when(F.col("may"), F.translate(body, ascii_uppercase, ascii_lowercase)).otherwise(body)))
    votes = F.flatten(F.transform("words", lambda w, i: F.transform(lists(w), lambda p: p + i)))
    df = df.withColumn("v", F.when(F.col("may") & F.arrays_overlap("words", _strings(index.anchors)), F.array_sort(votes)).otherwise(none)).withColumn("n_words", F.size("words").cast("bigint")).drop("words", "may")
    v = F.col("v")
    agreed = F.filter(v, lambda x, i: ((i == 0) | (F.get(v, i - 1) != x)) & F.coalesce(F.get(v, i + F.element_at(need, entry(x) + 1) - 1) == x, F.lit(False)))
    df = df.withColumn("agreed", F.when(F.size(v) > 0, agreed).otherwise(none)).drop("v")
    phrases = F.array_distinct(F.transform(F.filter("agreed", lambda x: x < index.notices * _PLACE), entry))
    df = df.withColumn("phrases", phrases)
    sure = F.filter("agreed", lambda x: (x < index.base * _PLACE) | ((x >= index.notices * _PLACE) & F.array_contains(F.col("phrases"), F.element_at(key, entry(x) + 1))))
    rows = F.transform(sure, lambda x: F.struct(entry(x).alias("entry"), (x % _PLACE - _SHIFT).alias("word"), F.element_at(label, entry(x) + 1).alias("label")))
    df = df.withColumn("found", rows).withColumn("base", F.filter("found", lambda f: f["entry"] < index.base))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda f: f["label"]))), ",")
    places = F.transform("base", lambda f: f["word"])
    added = {
        "n_words": F.col("n_words"), "found": F.col("found"), "n_base": F.size("base").cast("bigint"), "first_word": F.array_min(places), "last_word": F.array_max(places),
        "base_labels": names("base"), "labels": names("found"), "score": 1 - F.pow(F.lit(0.5), F.size("found").cast("double")),
    }
    return df.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in added], *[c.alias(n) for n, c in added.items()])
