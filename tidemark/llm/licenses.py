"""Licence scans by digests of canonical texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import text_of

# Equivalent spellings, each of the first counts as the second.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("sub-license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("https", "http"),
)

# The known licences, texts and the notices that stand for them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details.
You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_NAMES = ("0BSD", "AGPL-3.0", "Apache-2.0", "Artistic-1.0-Perl", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib")
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "The MIT License\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_2 + _BSD_3 + _BSD_END),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("BSL-1.0", _BOOST),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", _APACHE_HEADER),
    ("GPL-3.0", _GNU_HEADER.format("General Public License", 3)),
    ("GPL-2.0", _GNU_HEADER.format("General Public License", 2)),
    ("LGPL-3.0", _GNU_HEADER.format("Lesser General Public License", 3)),
    ("AGPL-3.0", _GNU_HEADER.format("Affero General Public License", 3)),
    ("MPL-2.0", _MPL_HEADER),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "Released into the public domain."),
    *((name, f"SPDX-License-Identifier: {name}") for name in _NAMES),
)

# Digests of the canonical long texts (whole, and up to the end of the terms), with a word that each holds.
KNOWN_DIGESTS = (
    ("Apache-2.0", "6074c3536c43b739207170b87d1681477d0f07374ed3d862ba461334cce848e3", "apache"),
    ("Apache-2.0", "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64", "apache"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe", "apache"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702", "artistic"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "creative"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60", "gnu"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826", "gnu"),
    ("GPL-1.0", "8a4692e318e41e8d96d4610f021d16f03ff4485322f3d81c00d2621fdda7b2b1", "gnu"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70", "gnu"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", "gnu"),
    ("GPL-2.0", "0248b317bc123a7424b6ff9799b9786ffde75241881994270612a604d03836cc", "gnu"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808", "gnu"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34", "gnu"),
    ("GPL-3.0", "335e2e9a39badb7f3faa5b6e393ff8b393f868383be9ddbf866c5821b34f4810", "gnu"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191", "gnu"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636", "gnu"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", "gnu"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2", "gnu"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260", "gnu"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "gnu"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df", "gnu"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", "gnu"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "gnu"),
    ("MPL-1.1", "010ef3e2d3efceb19d44336a9aba2f54fa650cd537869380f53f4d6acad82b50", "mozilla"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a", "mozilla"),
)

#: Each line that is taken for a copyright line has one of these.
_SIGNS = ("copyright", "(c)", "©", "all rights reserved")
#: A known text's anchor is a word that every text of the same digest holds as it stands: lines and
#: paragraphs without any anchor are passed over. With more anchors than this all are looked up.
MOST_ANCHORS = 64
#: So many known texts are broadcast (about 150 bytes each); more are shuffled.
BROADCAST_KNOWN = 100_000


def plain(text: Column) -> Column:
    """Lower case, without copyright lines, punctuation and spare white space."""
    low = F.lower(text)
    told = F.lit(False)
    for sign in _SIGNS:  # plain searches cost far less than the pattern, which few texts need
        told = told | low.contains(sign)
    lines = F.when(told, F.regexp_replace(low, r"(?m)^[^\n]*(?:\bcopyright\s*(?:\(c\)|©|\d)|\(c\)\s*\d|©|all rights reserved)[^\n]*$", " ")).otherwise(low)
    return F.trim(F.regexp_replace(lines, r"[^\p{L}\p{N}]+", " "))


def respelled(words: Column) -> Column:
    """Words between single spaces, equivalent spellings made one. A spelling is replaced twice over,
    as neighbours share a space, and only in texts that have it."""
    pairs = F.array(*[F.struct(*[F.lit(f" {x.replace('-', ' ')} ").alias(n) for n, x in zip("ab", pair, strict=True)]) for pair in SPELLINGS])
    put = lambda acc, x: F.replace(acc, x["a"], x["b"])
    return F.aggregate(pairs, F.concat(F.lit(" "), words, F.lit(" ")), lambda acc, x: F.when(acc.contains(x["a"]), put(put(acc, x), x)).otherwise(acc), lambda acc: F.trim(acc))


def digest(words: Column) -> Column:
    return F.sha2(respelled(words).cast("binary"), 256)


def _anchor(words: Column) -> Column:
    """The longest plain word of a canonical text that no spelling touches; null where there is none."""
    touched = sorted({w for pair in SPELLINGS for side in pair for w in side.replace("-", " ").split()})
    own = F.filter(F.split(words, " "), lambda w: w.rlike("^[a-z0-9]+$") & ~w.isin(touched))
    return F.element_at(F.array_sort(F.transform(own, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]


def known_licenses(spark: SparkSession, known=KNOWN, digests=KNOWN_DIGESTS) -> DataFrame:
    """digest, license and anchor of the known texts; a digest that two names share keeps the first name.
    A text without words is no licence."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(known)], "no int, license string, text string")
    rows = rows.select("no", "license", plain(F.col("text")).alias("words")).filter("words <> ''").select("no", "license", digest(F.col("words")).alias("digest"), _anchor(F.col("words")).alias("anchor"))
    if digests:
        more = spark.createDataFrame([(len(known) + i, *x) for i, x in enumerate(digests)], "no int, license string, digest string, anchor string")
        rows = rows.unionByName(more)
    return rows.groupBy("digest").agg(F.min_by("license", "no").alias("license"), F.min_by("anchor", "no").alias("anchor"))


def license_report(docs: DataFrame, known: DataFrame | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_digest, license, notices.

    ``license`` names the known licence whose canonical text is the whole text's, whatever its length.
    ``notices`` lists the licences whose canonical text is that of one of its lines or paragraphs (between
    blank lines), sorted and joined by commas (empty where there is none). ``known`` has digest, license and,
    where it can, an anchor (see known_licenses(); null: any line may match).

    Null texts count as empty, and neither they nor texts without words match anything; very long texts
    are digested whole; repeated rows each get their row; of known texts with equal digests the
    first one names it; an empty table gives no rows; other columns are not read, so none can clash.
    The joins are hash joins on digests; of the parts of texts only those with an anchor take part.
    """
    known = known_licenses(docs.sparkSession) if known is None else known
    known = known if "anchor" in known.columns else known.withColumn("anchor", F.lit(None).cast("string"))
    size = known.agg(F.count("*").alias("n"), F.count("anchor").alias("anchored")).first()
    anchors = [r["anchor"] for r in known.select("anchor").distinct().limit(MOST_ANCHORS + 1).collect()]
    all_parts = size["anchored"] < size["n"] or len(anchors) > MOST_ANCHORS
    names = known.select(F.col("digest").alias("_digest"), "license")
    names = F.broadcast(names) if size["n"] <= BROADCAST_KNOWN else names

    def anchored(x: Column) -> Column:
        """Whether one of the anchors is in it; the array holds the lowered text so that it is made once."""
        if all_parts:
            return F.lit(True)

        def any_of(t: Column) -> Column:
            out = F.lit(False)
            for word in sorted(anchors):
                out = out | t.contains(word)
            return out

        return F.exists(F.array(F.lower(x)), any_of)

    text = text_of(text_column)
    base = docs.select(F.col(id_column).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("_sha"), digest(plain(text)).alias("text_digest"))
    whole = base.join(names, F.col("text_digest") == F.col("_digest"), "left").drop("_digest")
    some = docs.select(F.col(id_column).alias("_id"), text.alias("_t")).filter(anchored(F.col("_t")))
    parts = F.concat(F.split("_t", "\n", -1), F.split("_t", r"\n[\x20\t\r]*\n", -1))
    parts = some.select("_id", F.sha2(F.col("_t").cast("binary"), 256).alias("_of"), F.explode(F.filter(parts, anchored)).alias("_part"))
    parts = parts.select("_id", "_of", digest(plain(F.col("_part"))).alias("_part"))
    notices = parts.join(names, F.col("_part") == F.col("_digest")).groupBy("_id", "_of").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    found = whole.join(notices, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_of")), "left")
    return found.select("doc_id", "text_digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))
