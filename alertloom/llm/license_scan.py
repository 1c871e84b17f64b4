"""Licence scans: canonical digests of entire texts, looked up by a hash join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.common import stash
from alertloom.llm.license_table import DIGESTS, IDENTIFIERS

# The texts of short public licences.
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = """BSD Zero Clause License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """zlib License

Copyright (c) <year> <copyright holders>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BSD_HEAD = """Copyright (c) <year> <owner>. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
LICENSES = {"MIT": MIT, "ISC": ISC, "0BSD": ZERO_BSD, "Zlib": ZLIB, "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL, "BSD-3-Clause": _BSD_HEAD + _BSD_NAME + _BSD_TAIL}

# Notices that name a licence by one line.
NOTICES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Released under the BSD 3-Clause License.": "BSD-3-Clause",
    "SPDX-License-Identifier: MIT": "MIT",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0",
}

# Spellings held equal, as in the guidelines for matching licence texts. Each is a whole word or phrase.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "copyright holder": "copyright owner", "copyright holders": "copyright owners",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "honour": "honor",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "non commercial": "noncommercial", "non infringement": "noninfringement", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "sub license": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "wilfull",
}
#: One alternation per replacement would scan the text once each; a group of all spellings finds the few texts that hold any.
ANY_SPELLING = r" (" + "|".join(sorted(SPELLINGS)) + r") "
COPYRIGHT_LINE = r"(?m)^[^a-zA-Z\n]*(?:[Cc]opyright|COPYRIGHT|©)(?:[ \t]*(?:\([cC]\)|©|[0-9]|<)[^\n]*)?$"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, every run of other than letters, digits and line ends a single space, a space at each end of
    a line."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, ""))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")
    return F.concat(F.lit(" "), F.regexp_replace(t, r" ?\n ?", " \n "), F.lit(" "))


def spelled(text: Column) -> Column:
    """One spelling for those held equal; most texts have none of them and pass by."""
    one = text
    for a, b in SPELLINGS.items():
        one = F.replace(one, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.when(text.rlike(ANY_SPELLING), one).otherwise(text)


def whole(text: Column) -> Column:
    """Digest of a canonical text as one line."""
    return F.sha2(F.trim(spelled(F.regexp_replace(text, r"[ \n]+", " "))), 256)


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license, digest) of the known licences and notices, SPDX lines of all identifiers and long texts by digest among them; two
    names of one digest keep the first, those of NOTICES before others."""
    rows = [(b, a) for a, b in NOTICES.items()] + list(LICENSES.items()) if texts is None else list(texts.items())
    lines = [(x, f"SPDX-License-Identifier: {x}") for x in IDENTIFIERS] if texts is None else []
    ranked = [(*x, 0) for x in sorted(rows)] + [(*x, 1) for x in lines]
    d = spark.createDataFrame(ranked, "license string, text string, rank int").withColumn("t", canonical(F.col("text"))).select("license", "rank", whole(F.col("t")).alias("digest"))
    if texts is None:
        d = d.union(spark.createDataFrame([(n, 1, g) for n, g in DIGESTS], "license string, rank int, digest string"))
    return d.groupBy("digest").agg(F.min(F.struct("rank", "license"))["license"].alias("license"))


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """Per document row: doc_id, digest of its whole canonical text, license of that digest or null, and line_licenses, the names,
    sorted and comma-joined, of the licences whose digest is that of a whole line (null without any).

    Null and empty texts have the digest of the empty text and no licence. Rows that repeat a doc_id share their lines' licences; an
    empty table gives an empty result; other columns are ignored. ``licenses`` (license, digest) may be of any size; texts and lines
    join it by digest, and only lines that match are shuffled further where it is small.
    """
    licenses = known(docs.sparkSession) if licenses is None else licenses.groupBy("digest").agg(F.min("license").alias("license"))
    licenses = licenses.filter(F.col("digest") != F.sha2(F.lit(""), 256))
    d = stash(docs.select("doc_id", canonical(F.col("text")).alias("t")).select("doc_id", whole(F.col("t")).alias("digest"), F.transform(F.split(spelled(F.col("t")), "\n"), lambda x: F.sha2(F.trim(x), 256)).alias("lines")))
    lines = d.select("doc_id", F.explode("lines").alias("digest")).join(licenses, "digest").groupBy(F.col("doc_id").alias("k")).agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("line_licenses"))
    d = d.select("doc_id", "digest").join(licenses, "digest", "left").join(lines, F.col("doc_id").eqNullSafe(F.col("k")), "left")
    return d.select("doc_id", "digest", "license", F.col("license").isNotNull().alias("is_license"), "line_licenses")
