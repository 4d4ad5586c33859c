"""Licence lookup by canonical digests, with DataFrame expressions only."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, applied in this order to the lower-cased words.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("acknowledgement", "acknowledgment"),
             ("authorise", "authorize"), ("authorised", "authorized"), ("favour", "favor"), ("organisation", "organization"),
             ("recognise", "recognize"), ("programme", "program"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
             ("per cent", "percent"), ("copyright owner", "copyright holder"),
             ("copyright owners", "copyright holders"), ("v2", "version 2"), ("v3", "version 3")]

# Public licence texts and the usual one-line notices, by identifier.
_WARRANTY = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
             "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
             "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
             "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY)
_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list "
             "of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright "
             "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
             "with the distribution.\n\n")
_BSD_3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
          "derived from this software without specific prior written permission.\n\n")
_BSD_TAIL = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
             "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
             "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
             "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
             "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
             "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
             "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.\n\n")
_0BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n"
_ISC_TAIL = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
             "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
             "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
             "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
             "THIS SOFTWARE.")
_ZLIB = ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
         "any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, "
         "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
         "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you "
         "use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
         "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
         "3. This notice may not be removed or altered from any source distribution.")
KNOWN = [
    ("MIT", "text", _MIT), ("MIT", "text", "MIT License\n\n" + _MIT), ("MIT", "text", "The MIT License (MIT)\n\n" + _MIT),
    ("BSD-2-Clause", "text", _BSD_HEAD + _BSD_TAIL), ("BSD-3-Clause", "text", _BSD_HEAD + _BSD_3 + _BSD_TAIL),
    ("BSD-2-Clause", "text", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", "text", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_3 + _BSD_TAIL),
    ("ISC", "text", _ISC + _ISC_TAIL), ("ISC", "text", "ISC License\n\n" + _ISC + _ISC_TAIL), ("0BSD", "text", _0BSD + _ISC_TAIL),
    ("Zlib", "text", _ZLIB), ("Zlib", "text", "zlib License\n\n" + _ZLIB),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "notice", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "notice", "Released under the MIT License."), ("MIT", "notice", "Licensed under the MIT License."), ("MIT", "notice", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "notice", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "notice", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "notice", "Released under CC0 1.0."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."), ("MPL-2.0", "notice", "Licensed under the Mozilla Public License, version 2.0."),
    ("all-rights-reserved", "notice", "All rights reserved."),
]
_APACHE_HEADER = ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n"
                  "You may obtain a copy of the License at\n\n    {}://www.apache.org/licenses/LICENSE-2.0\n\n"
                  "Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\n"
                  "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\n"
                  "limitations under the License.")
_UNLICENSE = ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, "
              "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
              "non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software "
              "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
              "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
              "relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
              + _WARRANTY.replace("NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE", "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE")
              + "\n\nFor more information, please refer to {}")
KNOWN += [(p.stem, "text", p.read_text()) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
KNOWN += [("Apache-2.0", "text", _APACHE_HEADER.format(x)) for x in ("http", "https")]
KNOWN += [("Unlicense", "text", _UNLICENSE.format(x)) for x in ("<http://unlicense.org/>", "<https://unlicense.org>", "<https://unlicense.org/>")]
KNOWN += [("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
          ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
          ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
          ("MPL-2.0", "notice", "License, v. 2.0. If a copy of the MPL was not distributed with this"),
          *[(i, "notice", f"SPDX-License-Identifier: {i}{e}") for i in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0") for e in ("", "-only", "-or-later")],
          *[(i, "notice", f"SPDX-License-Identifier: {i}") for i in ("MPL-2.0", "CC0-1.0", "Unlicense", "ISC", "Zlib", "0BSD", "BSD-2-Clause", "BSD-3-Clause")]]
COPYRIGHT_LINE = r"(?im)^[^a-z0-9\n]*(copyright\b|\(c\)|©)[^\n]*(19|20)[0-9][0-9][^\n]*$"


def canonical(c: Column) -> Column:
    """Lower case, no copyright lines, punctuation as blanks, equivalent spellings alike."""
    c = F.regexp_replace(c, COPYRIGHT_LINE, " ")
    c = F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for a, b in SPELLINGS:
        if a != b:
            c = F.replace(c, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(c, " +", " "))


def known(spark: SparkSession, entries: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Digests of known texts: (digest, license_id). As many rows as the list has."""
    rows = spark.createDataFrame(entries or KNOWN, "license_id string, kind string, body string")
    return rows.select(F.sha2(canonical(F.col("body")), 256).alias("digest"), "license_id").dropDuplicates(["digest"])


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """(doc_id, license_id, notices, n_notices): what the entire text is, and what its lines are.

    license_id is the licence whose canonical text has the digest of the whole document's canonical text, else null.
    notices are the identifiers, sorted, distinct and joined by commas, of lines that are known texts by themselves;
    n_notices counts such lines. Both are hash joins on digests; the table of digests is a literal list, and Spark
    broadcasts it if it is as small as that.

    Null or empty text, and text of copyright lines or punctuation only, match nothing. doc_id is only passed on: null
    and repeated ids each give their row. Extra columns are not read. Empty tables give no rows.
    """
    licenses = known(docs.sparkSession) if licenses is None else licenses
    row = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("rid"))
    # The canonical text is a column of its own, so that it is computed once.
    digest = lambda df: df.withColumn("c", canonical(F.col("t"))).where("c <> ''").withColumn("digest", F.sha2("c", 256))
    whole = row.withColumn("c", canonical(F.col("t"))).select("doc_id", "rid", F.when(F.col("c") != "", F.sha2("c", 256)).alias("digest"))
    whole = whole.join(licenses, "digest", "left").select("doc_id", "rid", "license_id")
    line = digest(row.select("rid", F.explode(F.split("t", "\n")).alias("t")))
    found = (line.select("rid", "digest").join(licenses, "digest")
             .groupBy("rid").agg(F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("notices"), F.count(F.lit(1)).alias("n_notices")))
    return whole.join(found, "rid", "left").select("doc_id", "license_id", F.coalesce("notices", F.lit("")).alias("notices"),
                                                   F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
