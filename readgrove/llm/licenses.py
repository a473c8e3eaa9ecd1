"""Licences named or quoted in texts, by known sentences in known order.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sentences of licences and notices as published and as ``sentence_lists`` cuts them, each under its identifier.
SENTENCES = {
    "apache-named": "Licensed under the Apache License, Version 2.0.",
    "apache-notice-1": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-notice-2": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-notice-3": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-named": "Released under the MIT License.",
    "mit-1": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "no-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl3-named": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-notice-2": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-notice-3": "See the GNU General Public License for more details.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-link": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mpl-notice-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "gpl2-notice-1": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21-notice-1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-library-1": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3-program-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-notice-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-named": "Licensed under CC BY 4.0.",
    "cc-by-sa-named": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-named": "Licensed under CC BY-NC 4.0.",
    "cc0-named": "Dedicated to the public domain under CC0 1.0.",
    "unlicense-1": "This is free and unencumbered software released into the public domain.",
}

#: Licences by their sentences in order, the first of equal reach wins; longer rules come first.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("Apache-2.0", ["apache-notice-1", "apache-copy", "apache-link", "apache-basis", "apache-notice-3"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is", "no-liability"]),
    ("Apache-2.0", ["apache-notice-1", "apache-notice-2", "apache-notice-3"]),
    ("MIT", ["mit-1", "as-is", "no-liability"]),
    ("GPL-3.0-or-later", ["gpl-notice-1", "gpl-notice-2", "gpl-notice-3"]),
    ("GPL-3.0-or-later", ["gpl-notice-1", "gpl-notice-2"]),
    ("Apache-2.0", ["apache-named"]),
    ("Apache-2.0", ["apache-notice-1"]),
    ("MIT", ["mit-named"]),
    ("MIT", ["mit-1"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-1"]),
    ("GPL-3.0", ["gpl3-named"]),
    ("GPL-3.0-or-later", ["gpl-notice-1"]),
    ("MPL-2.0", ["mpl-notice-1"]),
    ("GPL-2.0-or-later", ["gpl2-notice-1"]),
    ("LGPL-2.1-or-later", ["lgpl21-notice-1"]),
    ("LGPL-3.0-or-later", ["lgpl3-library-1"]),
    ("LGPL-3.0-or-later", ["lgpl3-program-1"]),
    ("AGPL-3.0-or-later", ["agpl3-notice-1"]),
    ("CC-BY-4.0", ["cc-by-named"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-named"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-named"]),
    ("CC0-1.0", ["cc0-named"]),
    ("Unlicense", ["unlicense-1"]),
]

#: Every known sentence has one of these letter runs, so a text without any holds none.
CUES = "(?i)(licen[sc]e|permission|warrant|liable|public domain|redistribut)"

#: What a sentence may start with and still be the same sentence.
LEAD = "^this (work|file|project|software|code|document|library|package|content|text) is "
ARTICLES = " (the|a|an) "


def normalised(sentence: Column) -> Column:
    """Lower case, letters and digits only, without articles and without what the licence is given to."""
    plain = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    return F.regexp_replace(F.regexp_replace(plain, LEAD, ""), ARTICLES, " ")


def sentence_lists(text: Column) -> tuple[Column, Column]:
    """Sentences with line ends as spaces, and those of every line by itself.

    A sentence ends at ``.``, ``!`` or ``?`` before white space and at an empty line.
    """
    ends = "([.!?])[\\x20\\t\\r\\n]+"
    mark = "$1\x01"
    whole = F.regexp_replace(F.regexp_replace(text, "\\n[\\x20\\t\\r]*\\n", "\x01"), ends, mark)
    lines = F.regexp_replace(F.regexp_replace(text, ends, mark), "\\n", "\x01")
    return F.split(whole, "\x01"), F.split(lines, "\x01")


def known_sentences(spark: SparkSession, sentences: dict[str, str]) -> DataFrame:
    """``known, sentence_id`` of the normalised sentences, one row each."""
    table = spark.createDataFrame(sorted(sentences.items()), "sentence_id string, text string")
    return table.select("sentence_id", normalised(F.col("text")).alias("known")).dropDuplicates(["known"])


def _matched(sequence: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Licences whose rule is in the sequence, where no earlier rule has used its sentences."""
    found, rest = [], sequence
    for licence, ids in rules:
        pattern = " " + "  ".join(ids) + " "
        found.append(F.when(F.contains(rest, F.lit(pattern)), F.lit(licence)))
        rest = F.replace(rest, F.lit(pattern), F.lit(" | "))
    return F.array_compact(F.array(*found))


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """``doc_id, n_sentences, licenses`` per row of ``docs``.

    ``n_sentences`` counts known sentences, ``licenses`` joins the names of the rules found, sorted
    and without repetition, by commas. Rules are tried in order; the sentences of one that is found
    serve no later rule. A sentence may run over lines; a line may also hold it alone, with other
    text in the lines around it. Null and empty texts have none; rows come back as often as
    given, null ids too; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), text.alias("text"))
    none = F.array(F.lit("")).cast("array<string>")
    lists = [F.when(F.col("text").rlike(CUES), s).otherwise(none) for s in sentence_lists(F.col("text"))]
    both = rows.select("row", "doc", F.posexplode(F.array(*lists)).alias("form", "list"))
    parts = both.select("row", "doc", "form", F.posexplode("list").alias("pos", "sentence"))
    # as many rows as there are known sentences, whatever the size of the documents
    known = F.broadcast(known_sentences(spark, sentences))
    hits = parts.withColumn("known", normalised(F.col("sentence"))).join(known, "known", "left")
    hits = hits.where(F.col("sentence_id").isNotNull() | (F.col("pos") == 0))
    listed = F.array_sort(F.collect_list(F.when(F.col("sentence_id").isNotNull(), F.struct("pos", "sentence_id"))))
    forms = hits.groupBy("row", "doc", "form").agg(listed.alias("found"))
    sequence = F.array_join(F.transform("found", lambda s: F.concat(F.lit(" "), s["sentence_id"], F.lit(" "))), "")
    forms = forms.select("row", "doc", F.size("found").cast("long").alias("n"), _matched(sequence, rules).alias("licences"))
    out = forms.groupBy("row", "doc").agg(F.max("n").alias("n_sentences"), F.flatten(F.collect_list("licences")).alias("names"))
    return out.select(F.col("doc").alias(id_col), "n_sentences", F.array_join(F.array_sort(F.array_distinct("names")), ",").alias("licenses"))
