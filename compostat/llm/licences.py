"""Licence scan by sentence rules.

A text is cut into sentences (at line feeds and after ``.``, ``!`` or ``?`` before a
blank), each sentence is normalised (ASCII lower case, runs of other ASCII characters
than letters and digits become one space), and known licence sentences are replaced
by their identifiers.  Lines that no ``.``, ``!`` or ``?`` and no blank line parts are
also tried together, from any line to any later one, so wrapped sentences are found in
texts and, as marks other than letters and digits count as blanks, in comments; of
overlapping finds the first and then the longest counts.  A known sentence may have a slot
(``*``) for a holder or an organisation, of 1 to ``SLOT`` characters; where its text has an
abbreviation's full stop at the end, what follows the slot is enough (one inside a name isn't
seen through).  An SPDX expression counts as a
line for each of its licences.  Identifiers at most ``max_gap`` sentences apart form a sequence;
ordered rules, longest claims first, each take their sequence of identifiers out of
it and name a licence.  A rule never fits across a sentence that isn't known: a line of
``LONG`` words or more that isn't part of a find or the beginning of one up to its slot, a web
address or a copyright line ends a sequence.  What no rule takes is counted as unmatched.

All of it is DataFrame operations: sentences meet the known ones in a broadcast join
(the table of known sentences is a parameter of checked size), so only recognised
sentences are ever shuffled.

Defined cases: null and empty texts have no sentence and no licence; repeated
sentences count each time; a licence found twice is named once; of identifiers that share
a sentence the first in the table counts, of rules that fit the first; rows with the same
id have one row each and equal rows equal results; very long texts are scanned in blocks of
lines; empty tables give empty tables; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_SENTENCES = 100_000
#: Lines exploded together.
_BLOCK = 64
#: Characters of a slot at most; words of a line that counts as a sentence.
SLOT, LONG = 160, 4
#: Other licences of an SPDX expression get a line of their own.
_SPDX = r"(?<=SPDX-License-Identifier:[^\n]{0,200}?)[ ]+(?:OR|AND|WITH)[ ]+"

# Normalised sentences of public licence texts, and statements of licence.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("mit_grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit_notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit_as_is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit_liability", "in no event shall * be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit_name", "released under the mit license"),
    ("mit_name", "licensed under the mit license"),
    ("mit_name", "released under the mit license see license"),
    ("mit_name", "licensed under the mit license see license"),
    ("mit_name", "this project is licensed under the mit license"),
    ("mit_name", "this project is licensed under the mit license see the license file for details"),
    ("apache2_name", "licensed under the apache license version 2 0"),
    ("apache2_name", "licensed under the apache license version 2 0 the license"),
    ("apache2_comply", "you may not use this file except in compliance with the license"),
    ("apache2_copy", "you may obtain a copy of the license at"),
    ("apache2_basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache2_see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mpl2_subject", "this source code form is subject to the terms of the mozilla public license v"),
    ("mpl2_copy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl2_copy", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("mpl2_name", "licensed under the mozilla public license version 2 0"),
    ("lgpl21_free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl3_free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl_hope", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl_copy", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("agpl3_free", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl_copy", "you should have received a copy of the gnu affero general public license along with this program"),
    ("isc_grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc_grant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc_as_is", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("zero_bsd_grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense_free", "this is free and unencumbered software released into the public domain"),
    ("zlib_as_is", "this software is provided as is without any express or implied warranty"),
    ("zlib_grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("gpl_free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2_free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl2_only_free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license"),
    ("gpl2_only_free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl3_only_free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license"),
    ("gpl3_only_free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation"),
    ("gpl_copy", "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"),
    ("gpl_copy", "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"),
    ("epl2_terms", "this program and the accompanying materials are made available under the terms of the eclipse public license v"),
    ("epl2_terms", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("epl2_name", "licensed under the eclipse public license version 2 0"),
    ("boost_name", "distributed under the boost software license version 1 0"),
    ("boost_grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("gpl_hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl_copy", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl3_name", "this work is licensed under the gnu general public license version 3"),
    ("gpl3_name", "licensed under the gnu general public license version 3"),
    ("bsd_grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd_source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd_binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd_endorse", "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd_advertise", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd_advertise", "all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by *"),
    ("bsd_acknowledge", "this product includes software developed by *"),
    ("bsd_as_is", "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("cc_by4_name", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc_by_sa4_name", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc_by_nc4_name", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc_by_nc4_name", "licensed under cc by nc 4 0"),
    ("cc_by4_name", "licensed under cc by 4 0"),
    ("cc_by_sa4_name", "licensed under cc by sa 4 0"),
    ("cc0_name", "licensed under cc0 1 0"),
    ("public_domain", "this work is in the public domain"),
    ("reserved", "all rights reserved"),
    ("spdx_mit", "spdx license identifier mit"),
    ("spdx_apache2", "spdx license identifier apache 2 0"),
    ("spdx_gpl3", "spdx license identifier gpl 3 0 or later"),
    ("spdx_gpl3_only", "spdx license identifier gpl 3 0 only"),
    ("spdx_gpl2", "spdx license identifier gpl 2 0 or later"),
    ("spdx_gpl2_only", "spdx license identifier gpl 2 0 only"),
    ("spdx_gpl2_only", "spdx license identifier gpl 2 0"),
    ("spdx_gpl3_only", "spdx license identifier gpl 3 0"),
    ("spdx_lgpl21_only", "spdx license identifier lgpl 2 1 only"),
    ("spdx_lgpl3_only", "spdx license identifier lgpl 3 0 only"),
    ("spdx_agpl3_only", "spdx license identifier agpl 3 0 only"),
    ("spdx_epl2", "spdx license identifier epl 2 0"),
    ("spdx_boost", "spdx license identifier bsl 1 0"),
    ("spdx_bsd4", "spdx license identifier bsd 4 clause"),
    ("spdx_zero_bsd", "spdx license identifier 0bsd"),
    ("spdx_zlib", "spdx license identifier zlib"),
    ("spdx_cc_by4", "spdx license identifier cc by 4 0"),
    ("spdx_cc_by_sa4", "spdx license identifier cc by sa 4 0"),
    ("spdx_lgpl21", "spdx license identifier lgpl 2 1 or later"),
    ("spdx_lgpl3", "spdx license identifier lgpl 3 0 or later"),
    ("spdx_agpl3", "spdx license identifier agpl 3 0 or later"),
    ("spdx_mpl2", "spdx license identifier mpl 2 0"),
    ("spdx_bsd2", "spdx license identifier bsd 2 clause"),
    ("spdx_bsd3", "spdx license identifier bsd 3 clause"),
    ("spdx_isc", "spdx license identifier isc"),
    ("spdx_cc0", "spdx license identifier cc0 1 0"),
    ("spdx_unlicense", "spdx license identifier unlicense"),
)

#: Ordered rules: (licence, sequence of sentence identifiers); "$" at the end: no unknown
#: sentence may follow.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is", "mit_liability")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("Apache-2.0", ("apache2_name", "apache2_comply", "apache2_copy", "apache2_basis", "apache2_see")),
    ("Apache-2.0", ("apache2_name", "apache2_comply", "apache2_copy", "apache2_basis")),
    ("Apache-2.0", ("apache2_name", "apache2_comply", "apache2_copy")),
    ("MPL-2.0", ("mpl2_subject", "mpl2_copy")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope", "gpl_copy")),
    ("GPL-3.0-or-later", ("gpl_free",)),
    ("GPL-2.0-or-later", ("gpl2_free", "gpl_hope", "gpl_copy")),
    ("GPL-2.0-or-later", ("gpl2_free",)),
    ("GPL-2.0-only", ("gpl2_only_free", "gpl_hope", "gpl_copy")),
    ("GPL-2.0-only", ("gpl2_only_free",)),
    ("GPL-3.0-only", ("gpl3_only_free", "gpl_hope", "gpl_copy")),
    ("GPL-3.0-only", ("gpl3_only_free",)),
    ("EPL-2.0", ("epl2_terms",)),
    ("EPL-2.0", ("epl2_name",)),
    ("BSL-1.0", ("boost_grant",)),
    ("BSL-1.0", ("boost_name",)),
    ("LGPL-2.1-or-later", ("lgpl21_free", "lgpl_hope", "lgpl_copy")),
    ("LGPL-2.1-or-later", ("lgpl21_free", "lgpl_hope")),
    ("LGPL-2.1-or-later", ("lgpl21_free",)),
    ("LGPL-3.0-or-later", ("lgpl3_free", "lgpl_hope", "lgpl_copy")),
    ("LGPL-3.0-or-later", ("lgpl3_free", "lgpl_hope")),
    ("LGPL-3.0-or-later", ("lgpl3_free",)),
    ("AGPL-3.0-or-later", ("agpl3_free", "gpl_hope", "agpl_copy")),
    ("AGPL-3.0-or-later", ("agpl3_free", "gpl_hope")),
    ("AGPL-3.0-or-later", ("agpl3_free",)),
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advertise", "bsd_acknowledge", "bsd_endorse", "bsd_as_is")),
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advertise", "bsd_acknowledge", "bsd_endorse")),
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advertise", "bsd_endorse", "bsd_as_is")),
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advertise", "bsd_endorse")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_as_is")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "$")),
    ("BSD, clauses unknown", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("ISC", ("isc_grant", "isc_as_is")),
    ("ISC", ("isc_grant",)),
    ("0BSD", ("zero_bsd_grant", "isc_as_is")),
    ("Zlib", ("zlib_as_is", "zlib_grant")),
    ("Unlicense", ("unlicense_free",)),
    ("MIT", ("mit_name",)),
    ("Apache-2.0", ("apache2_name",)),
    ("MPL-2.0", ("mpl2_name",)),
    ("GPL-3.0-only", ("gpl3_name",)),
    ("CC-BY-NC-4.0", ("cc_by_nc4_name",)),
    ("CC-BY-4.0", ("cc_by4_name",)),
    ("CC-BY-SA-4.0", ("cc_by_sa4_name",)),
    ("CC0-1.0", ("cc0_name",)),
    ("public domain", ("public_domain",)),
    ("MIT", ("spdx_mit",)),
    ("Apache-2.0", ("spdx_apache2",)),
    ("GPL-3.0-or-later", ("spdx_gpl3",)),
    ("GPL-3.0-only", ("spdx_gpl3_only",)),
    ("GPL-2.0-or-later", ("spdx_gpl2",)),
    ("GPL-2.0-only", ("spdx_gpl2_only",)),
    ("LGPL-2.1-only", ("spdx_lgpl21_only",)),
    ("LGPL-3.0-only", ("spdx_lgpl3_only",)),
    ("AGPL-3.0-only", ("spdx_agpl3_only",)),
    ("EPL-2.0", ("spdx_epl2",)),
    ("BSL-1.0", ("spdx_boost",)),
    ("BSD-4-Clause", ("spdx_bsd4",)),
    ("0BSD", ("spdx_zero_bsd",)),
    ("Zlib", ("spdx_zlib",)),
    ("CC-BY-4.0", ("spdx_cc_by4",)),
    ("CC-BY-SA-4.0", ("spdx_cc_by_sa4",)),
    ("LGPL-2.1-or-later", ("spdx_lgpl21",)),
    ("LGPL-3.0-or-later", ("spdx_lgpl3",)),
    ("AGPL-3.0-or-later", ("spdx_agpl3",)),
    ("MPL-2.0", ("spdx_mpl2",)),
    ("BSD-2-Clause", ("spdx_bsd2",)),
    ("BSD-3-Clause", ("spdx_bsd3",)),
    ("ISC", ("spdx_isc",)),
    ("CC0-1.0", ("spdx_cc0",)),
    ("Unlicense", ("spdx_unlicense",)),
    ("all rights reserved", ("reserved",)),
)


def normalised(sentence: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(sentence, _UPPER, _UPPER.lower()), _OTHER, " "))


def slots(known: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """(fixed words before, after) of the sentences with a slot."""
    return [tuple(part.strip() for part in s.split("*")) for _, s in known if "*" in s]


def with_slots(key: Column, known: Sequence[tuple[str, str]]) -> Column:
    """The normalised sentence with what stands in a known slot as ``*``."""
    for head, tail in slots(known):
        rest = f" {tail}" if tail else ""
        key = F.regexp_replace(key, f"^{head} .{{1,{SLOT}}}?{rest}$", f"{head} *{rest}")
    return key


def after_slots(known: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Known sentences, and what follows a slot by itself where that is long enough to tell."""
    return [*known, *((i, s.split("* ")[1]) for i, s in known if "* " in s and s.split("* ")[1].count(" ") >= 7)]


def exempt(known: Sequence[tuple[str, str]]) -> str:
    """Pattern of lines that end no sequence: addresses, copyright lines, what begins a known
    sentence up to its slot (the rest may stand behind an abbreviation's full stop)."""
    return "^(" + "|".join(["https?", "copyright", *(head for head, _ in slots(known))]) + ") "


def unknown_line(line: Column, pattern: str) -> Column:
    """Whether a line that no find has ends a sequence."""
    key = normalised(line)
    return (F.size(F.split(key, " ")) >= LONG) & ~F.regexp_like(key, F.lit(pattern))


def sentences(text: Column) -> Column:
    text = F.when(F.contains(text, F.lit("SPDX-License-Identifier:")), F.regexp_replace(text, _SPDX, "\nSPDX-License-Identifier: ")).otherwise(text)
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1\n"), "\n", -1)


def _steps(rules: Sequence[tuple[str, Sequence[str]]]) -> list[tuple[str, str, str]]:
    """(licence, what the marked sequence must have, what is left in its place)."""
    out = []
    for licence, ids in rules:
        sequence = "".join(f"<{i}>" for i in ids if i != "$")
        out += [(licence, sequence + end, "|" + end) for end in ("|", "<")] if ids[-1] == "$" else [(licence, sequence, "|")]
    return out


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    known: Sequence[tuple[str, str]] = SENTENCES,
    rules: Sequence[tuple[str, Sequence[str]]] = RULES,
    max_gap: int = 3,
) -> DataFrame:
    """``(id, n_known, sentence_ids, licenses, n_unmatched)`` per row: identifiers in
    text order and licences in rule order, joined by commas."""
    if len(known) > MAX_SENTENCES:
        raise ValueError(f"over {MAX_SENTENCES} known sentences")
    # Of identifiers that share a sentence the first in the table counts.
    patterns = [x for x in known if "*" in x[1]]
    known = [(i, s) for s, i in {s: i for i, s in reversed(after_slots(known))}.items()]
    words = max((len(s.split(" ")) for _, s in known), default=1)
    table = F.broadcast(df.sparkSession.createDataFrame(list(known), "__sid string, __key string"))
    rows = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).withColumn("__row", F.xxhash64("__id", "__text"))
    # A known sentence starts at a line that is one or starts one: all starts are in a broadcast join.
    starts = table.select(F.split("__key", " ").alias("w")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda n: F.xxhash64(F.array_join(F.slice("w", 1, n), " ")))).alias("__hash")).distinct()
    # Lines are exploded block by block, so that each carries a block of lines and not its text.
    cut = rows.select("__id", "__row", sentences(F.col("__text")).alias("__all"))
    blocks = F.transform(F.sequence(F.lit(0), F.size("__all") - 1, F.lit(_BLOCK)), lambda at: F.struct(at.alias("at"), F.slice("__all", at + 1, _BLOCK + words).alias("lines")))
    cut = cut.select("__id", "__row", F.explode(blocks).alias("__b")).select("__id", "__row", "__b", F.posexplode(F.slice("__b.lines", 1, _BLOCK)).alias("__in", "__s"))
    begun = cut.withColumn("__key", normalised(F.col("__s"))).withColumn("__hash", F.xxhash64("__key")).join(F.broadcast(starts.withColumn("__start", F.lit(True))), "__hash", "left")
    heads = F.coalesce("__start", F.lit(False))
    for head, _ in slots(patterns):
        heads = heads | F.col("__key").startswith(head + " ")
    begun = begun.filter(heads).select("__id", "__row", (F.col("__b.at") + F.col("__in")).alias("__pos"), F.slice("__b.lines", F.col("__in") + 1, words).alias("__next"))
    # Lines from there to the first that ends a sentence or comes before a blank one.
    ends = F.array_position(F.transform("__next", lambda x: F.right(x, F.lit(1)).isin(".", "!", "?")), True)
    blank = F.array_position(F.transform("__next", lambda x: normalised(x) == ""), True)
    n_lines = F.least(F.size("__next"), F.nullif(ends, F.lit(0)), F.nullif(blank, F.lit(0)) - 1)
    tried = begun.select("__id", "__row", "__pos", "__next", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(1), n_lines).cast("bigint"))).alias("__n"))
    tried = tried.select("__id", "__row", "__pos", F.col("__n").cast("int").alias("__n"), with_slots(normalised(F.array_join(F.slice("__next", 1, F.col("__n").cast("int")), " ")), patterns).alias("__key"), "__next")
    # The first line behind a find that no known sentence explains; none among the next is far.
    behind = F.array_position(F.transform(F.expr("slice(__next, __n + 1, 60)"), lambda x: unknown_line(x, exempt(patterns))), True)
    clear = F.when(behind > 0, F.col("__pos") + F.col("__n") + behind - 1).otherwise(F.lit(1 << 40)).cast("bigint")
    found = tried.join(table, "__key").groupBy("__id", "__row").agg(F.array_sort(F.collect_set(F.struct("__pos", (-F.col("__n")).alias("__m"), "__sid", clear.alias("__clear")))).alias("__seq"))
    # What starts within an earlier find goes, and so do shorter finds at the same line.
    none = F.struct(F.filter("__seq", lambda x: F.lit(False)).alias("s"), F.lit(-1).alias("e"))
    apart = F.aggregate("__seq", none, lambda a, x: F.when(x["__pos"] > a["e"], F.struct(F.concat(a["s"], F.array(x)).alias("s"), (x["__pos"] - x["__m"] - 1).alias("e"))).otherwise(a), lambda a: a["s"])
    found = found.withColumn("__seq", F.when(F.exists("__seq", lambda x: x["__m"] < -1), apart).otherwise(F.col("__seq")))
    # Identifiers in angle brackets; where a sequence ends a bar, or a tilde if an unknown sentence follows.
    ending = lambda p, c, nxt: F.when((c < nxt) & (c - p <= max_gap), F.lit("~")).when(nxt - p > max_gap, F.lit("|")).otherwise(F.lit(""))
    far = F.lit(1 << 41).cast("bigint")
    start = F.struct(F.lit("").alias("t"), F.lit(-1_000_000).cast("bigint").alias("p"), far.alias("c"))
    token = F.aggregate(
        "__seq", start, lambda a, x: F.struct(F.concat(a["t"], ending(a["p"], a["c"], x["__pos"]), F.lit("<"), x["__sid"], F.lit(">")).alias("t"), (x["__pos"] - x["__m"] - 1).cast("bigint").alias("p"), x["__clear"].alias("c")),
        lambda a: F.concat(a["t"], ending(a["p"], a["c"], far)),
    )
    marked = found.withColumn("__t", token).withColumn("__found", F.array().cast("array<string>"))
    for licence, sequence, left in _steps(rules):
        marked = marked.withColumn("__found", F.when(F.contains("__t", F.lit(sequence)), F.concat("__found", F.array(F.lit(licence)))).otherwise(F.col("__found"))).withColumn("__t", F.replace("__t", F.lit(sequence), F.lit(left)))
    result = marked.select(
        F.col("__id").alias("__i"), F.col("__row").alias("__r"), F.size("__seq").cast("bigint").alias("n_known"), F.array_join(F.transform("__seq", lambda x: x["__sid"]), ",").alias("sentence_ids"),
        F.array_join(F.array_distinct("__found"), ",").alias("licenses"), (F.char_length("__t") - F.char_length(F.replace("__t", F.lit("<"), F.lit("")))).cast("bigint").alias("n_unmatched"),
    )
    keys = rows.select("__id", "__row")
    met = keys.join(result, keys["__id"].eqNullSafe(result["__i"]) & (keys["__row"] == result["__r"]), "left")
    zero = F.lit(0).cast("bigint")
    return met.select(F.col("__id").alias(id_col), F.coalesce("n_known", zero).alias("n_known"), F.coalesce("sentence_ids", F.lit("")).alias("sentence_ids"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_unmatched", zero).alias("n_unmatched"))


def oracle_sql(known: Sequence[tuple[str, str]] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES, max_gap: int = 3) -> str:
    """The same scan of ``documents`` in DuckDB's SQL, each line by itself: it knows nothing
    of wrapped sentences."""
    patterns = [x for x in known if "*" in x[1]]
    first = {s: i for i, s in reversed(after_slots(known))}
    values = ", ".join(f"('{i}', '{s}')" for s, i in first.items())
    key = f"trim(regexp_replace(translate(s, '{_UPPER}', '{_UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"
    slotted = "k0"
    for head, tail in slots(patterns):
        rest = f" {tail}" if tail else ""
        slotted = f"regexp_replace({slotted}, '^{head} .{{1,{SLOT}}}?{rest}$', '{head} *{rest}')"
    steps, last = [], "r0"
    for k, (licence, sequence, left) in enumerate(_steps(rules)):
        steps.append(f"r{k + 1} AS (SELECT doc_id, n, ids, CASE WHEN contains(t, '{sequence}') THEN list_append(f, '{licence}') ELSE f END AS f, replace(t, '{sequence}', '{left}') AS t FROM {last})")
        last = f"r{k + 1}"
    return f"""WITH known AS (SELECT * FROM (VALUES {values}) AS k(sid, skey)),
cut AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)) AS s FROM documents)),
keyed AS (SELECT doc_id, pos, k0, {slotted} AS skey FROM (SELECT doc_id, pos, {key} AS k0 FROM cut)),
met AS (SELECT doc_id, pos, sid, min(CASE WHEN sid IS NULL AND len(string_split(k0, ' ')) >= {LONG} AND NOT regexp_matches(k0, '{exempt(patterns)}') THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS strange FROM keyed LEFT JOIN known USING (skey)),
gap AS (SELECT *, CASE WHEN coalesce(strange < nxt, FALSE) AND strange - pos <= {max_gap} THEN '~' WHEN nxt - pos > {max_gap} THEN '|' ELSE '' END AS ending FROM (SELECT *, lead(pos, 1, 1000000000000) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM met WHERE sid IS NOT NULL)),
r0 AS (SELECT doc_id, count(*) AS n, string_agg(sid, ',' ORDER BY pos) AS ids, CAST([] AS VARCHAR[]) AS f, string_agg('<' || sid || '>' || ending, '' ORDER BY pos) AS t FROM gap GROUP BY doc_id),
{", ".join(steps)}
SELECT d.doc_id, coalesce(n, 0) AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(list_transform(range(0, len(u)), lambda i: u[i + 1]), ','), '') AS licenses, coalesce(length(t) - length(replace(t, '<', '')), 0) AS n_unmatched
FROM documents d LEFT JOIN (SELECT *, list_filter(f, lambda x, i: list_position(f, x) = i) AS u FROM {last}) r USING (doc_id)"""
