"""License scans: MinHash bands over text windows, exact containment; Spark SQL functions only (operator 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: License notices and whole license texts (-text) looked for.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSD-3-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written
        permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
        OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
        be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that
        you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such,
        and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from
        any source distribution.""",
}
SHINGLE, CONTAINMENT = 5, 0.8
#: Windows of 24 words every 8 words hold any passage of 17 words whole. A full window has 20 shingles. Bands have one
#: row: two full windows with k shingles in common have Jaccard similarity j = k / (40 - k) and meet in one of 256 bands
#: with probability 1 - (1 - j)^256, that is 0.9987 for k = 1 and more than 0.999998 from k = 2 on.
WINDOW, STEP, BANDS = 24, 8, 256


def shingle_hashes(text) -> F.Column:
    """Hash of each run of five words of a text (words: runs of a-z and 0-9 after lower-casing)."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    joined = F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])))
    enough = F.size(words) >= SHINGLE
    return F.when(enough, F.get(joined, F.lit(0))).otherwise(F.array().cast("array<bigint>"))


def windows(shingles) -> F.Column:
    """Overlapping windows of shingle hashes; the last one reaches the end."""
    width = WINDOW - SHINGLE + 1
    starts = F.sequence(F.lit(0), F.greatest(F.size(shingles) - 1, F.lit(0)), F.lit(STEP))
    return F.transform(starts, lambda i: F.slice(shingles, i + 1, width))


def signature(window) -> F.Column:
    """Smallest hash of a window's shingles in each band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform(window, lambda x: F.xxhash64(x, k))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, shingles: the distinct shingle hashes of each template (shorter ones than five words: none)."""
    t = spark.createDataFrame(list(templates.items()), "license string, body string")
    return t.select("license", shingle_hashes(F.col("body")).alias("ordered")).withColumn("shingles", F.array_distinct("ordered"))


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, license, containment, n_shared, n_shingles) for each template that a row's text contains.

    A template is contained if ``containment`` or more of its distinct five-word shingles are in the text.
    Windows retrieve it when their smallest hash in a band equals that of a window of the template. Such a
    window holds the shingle that has this hash, so documents without any of the templates' smallest
    shingles cannot collide and leave before their signatures are made: the result is the same. Null, empty
    and short texts match nothing; repeated rows give repeated results.
    """
    spark = docs.sparkSession
    t = template_table(spark, templates)
    pieces = t.select("license", F.explode(windows(F.col("ordered"))).alias("w")).filter(F.size("w") > 0)
    bands = pieces.select("license", F.posexplode(signature(F.col("w"))).alias("band", "value")).distinct()
    # templates are a fixed list given by the caller, so their hashes are a fixed number of constants
    smallest = pieces.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform("w", lambda x: F.struct(F.xxhash64(x, k).alias("h"), x.alias("x"))))["x"])).alias("x"))
    keys = [r[0] for r in smallest.distinct().collect()]
    if not keys:
        kind = docs.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"`{id_col}` {kind}, license string, containment double, n_shared int, n_shingles int")
    some = lambda s: F.exists(s, lambda x: x.isin(keys))
    d = docs.select(F.col(id_col).alias(id_col), F.col(text).cast("string").alias("_t")).filter(F.col("_t").isNotNull())
    d = d.select(F.col(id_col), shingle_hashes(F.col("_t")).alias("s")).filter(some(F.col("s")))
    held = materialize(d.withColumn("uid", F.monotonically_increasing_id()), "licenses")
    win = held.select("uid", F.explode(windows(F.col("s"))).alias("w")).filter(some(F.col("w")))
    sig = win.select("uid", F.posexplode(signature(F.col("w"))).alias("band", "value"))
    candidates = sig.join(F.broadcast(bands), ["band", "value"]).select("uid", "license").distinct()
    shared = F.size(F.array_intersect("s", "shingles"))
    pairs = candidates.join(held, "uid").join(F.broadcast(t.select("license", "shingles")), "license")
    pairs = pairs.select(id_col, "license", shared.alias("n_shared"), F.size("shingles").alias("n_shingles"))
    share = F.round(F.col("n_shared") / F.col("n_shingles"), 6)
    return pairs.filter(F.col("n_shared") >= containment * F.col("n_shingles")).select(id_col, "license", share.alias("containment"), "n_shared", "n_shingles")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, containment, n_shared, n_shingles of each license text that a document holds to the least share.

    Null and empty texts, and documents without such a text, have no rows; a null doc_id keeps its rows; each repeated row
    is scanned by itself. An empty table gives no rows. Other columns of the table are not read.
    """
    return find_licenses(table(spark, sf_dir, "documents"))


def oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({q(k)}, {q(v)})" for k, v in TEMPLATES.items())
    grams = "list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' ')))"
    split = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
with t as (select license, {grams} as g from (select license, {split.format("body")} as w from (values {rows}) v(license, body))),
d as (select doc_id, {grams} as g from (select doc_id, {split.format("text")} as w from documents where text is not null)),
p as (select doc_id, license, len(list_intersect(d.g, t.g))::int as n_shared, len(t.g)::int as n_shingles from d, t where len(t.g) > 0)
select doc_id, license, round(n_shared::double / n_shingles, 6) as containment, n_shared, n_shingles from p where n_shared >= {CONTAINMENT} * n_shingles
"""
