"""License scans: MinHash bands over overlapping windows, in DataFrame operations only.

A template is a set of shingles of five words. A document is read in overlapping windows
of several lengths; each template of n words belongs to the shortest length L >= n, and
windows of 2 L words start at every L-th word, so that some window holds any stretch of L
words whole. A template is found where one window of its length holds 80 % of its
shingles: an occurrence may have words added, left out or replaced, as long as its
stretch stays within such a window; text that is torn further apart counts as no occurrence.

A window that holds 80 % of a template has a Jaccard similarity of at least 0.8 n / (2 L + n)
to it; ROWS = 1 row in each of BANDS bands then meets in some band with the probability
that :func:`chance` gives, above 0.999 for every template here. A match is confirmed by
exact containment of the template's shingles, by their words.

Windows are hashed only near cue words of their length's templates. These are taken so
that more than a fifth of the shingles of every template hold one; a window with 80 % of
a template then holds a cue word, and no match is lost. Only windows that meet some
template in a band go on with their words.

Tokens are runs of letters and digits in lower case. Defined results: null and empty
texts match nothing; very long ones are read whole; a template of fewer than five words is one shingle; rows with the
same doc_id and template are reported once, with the best window.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import table
from pulseloom.llm.decontamination import tokens

SHINGLE, CONTAINED, BANDS = 5, 0.8, 64
#: Well-known notices of public licenses: fixed values.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mit": "Released under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "bsd-2-clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def cut(text: str) -> list[str]:
    """The tokens of a template, as :func:`tokens` has them."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def cues(templates: Mapping[str, str]) -> list[str]:
    """Words so that more than a fifth of the shingles of each template hold one; of those that serve, the longest."""
    chosen: list[str] = []
    for text in templates.values():
        words = cut(text)
        sets = [words[i : i + SHINGLE] for i in range(max(1, len(words) - SHINGLE + 1))]
        need = math.floor(round(len(sets) * (1 - CONTAINED), 9)) + 1
        while (open_need := need - sum(any(c in s for c in chosen) for s in sets)) > 0:
            held = Counter(w for s in sets if not any(c in s for c in chosen) for w in set(s))
            chosen.append(max(held, key=lambda w: (len(w) > 4, min(held[w], open_need), len(w), w)))
    return chosen


def any_of(text: Column, words: list[str]) -> Column:
    """Whether the text contains one of the words at least."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def length_class(n: int) -> int:
    """The shortest window class that holds n tokens: 6, 8, 16, 32, ..."""
    return 6 if n <= 6 else max(8, 1 << (n - 1).bit_length())


def chance(n: int, bands: int = BANDS) -> float:
    """Least probability that a window holding 80 % of a template of n tokens meets it in a band."""
    shingles, window = max(1, n - SHINGLE + 1), max(1, 2 * length_class(n) - SHINGLE + 1)
    inside = math.ceil(CONTAINED * shingles)
    return 1 - (1 - inside / (window + shingles - inside)) ** bands


def shingles(words: Column) -> Column:
    """The shingles of an array of tokens, in order; fewer tokens than a shingle are one."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
    return F.when(n >= SHINGLE, many).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def bands(sh: Column, n: int = BANDS) -> Column:
    """One MinHash value for each band."""
    base = F.transform(sh, lambda s: F.xxhash64(s))
    low = lambda i: F.array_min(F.transform(base, lambda h: F.xxhash64(h, i)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.xxhash64(i, low(i)))


def scanned(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, template, containment, start, n_tokens): license templates found, with the best window of each.

    ``start`` and ``n_tokens`` give the first matching shingle and the extent of the match, in tokens.
    """
    spark = docs.sparkSession
    of_class: dict[int, dict[str, str]] = {}
    for name, text in templates.items():
        of_class.setdefault(length_class(len(cut(text))), {})[name] = text
    rows = [(name, cut(text), size) for size, group in of_class.items() for name, text in group.items()]
    wanted = spark.createDataFrame(rows, "template string, words array<string>, class int")
    wanted = wanted.select("template", "class", F.array_distinct(shingles(F.col("words"))).alias("wanted"))
    keys = wanted.select("template", "class", F.explode(bands(F.col("wanted"))).alias("band"))
    words = {size: cues(group) for size, group in sorted(of_class.items())}
    near = docs.select("doc_id", "text").where(any_of(F.lower(F.col("text")), sorted(set().union(*words.values()))))
    told = near.select("doc_id", tokens("text").alias("w"))

    # Windows of class L start at multiples of L; a token lies in the one of its own multiple and the one before.
    def near_cues(size: int) -> Column:
        hits = F.filter(F.transform("w", lambda w, i: F.when(w.isin(words[size]), F.floor(i / size))), lambda i: i.isNotNull())
        multiples = F.transform(F.array_distinct(hits), lambda k: F.array(k, F.greatest(k - 1, F.lit(0))))
        start = lambda k: F.struct(F.lit(size).alias("class"), (k * size).cast("int").alias("from"))
        return F.transform(F.array_distinct(F.flatten(multiples)), start)

    told = told.withColumn("at", F.concat(*[near_cues(size) for size in words]))
    windows = told.select("doc_id", "w", F.explode_outer("at").alias("at")).select(
        "doc_id", F.col("at.class").alias("class"), F.col("at.from").alias("from"), F.slice("w", F.col("at.from") + 1, F.col("at.class") * 2).alias("w")
    )
    met = windows.select("doc_id", "from", "class", "w", F.explode_outer(bands(shingles(F.col("w")))).alias("band"))
    # A few rows for each template, whose number is the caller's.
    small = F.broadcast(keys)
    pairs = met.join(small, ["class", "band"]).select("doc_id", "from", "w", "template").distinct()
    sure = pairs.join(F.broadcast(wanted.drop("class")), "template").withColumn("sh", shingles(F.col("w")))
    inside = F.array_intersect("sh", "wanted")
    places = F.transform(inside, lambda s: F.array_position("sh", s))
    sure = sure.select("doc_id", "template", (F.size(inside) / F.size("wanted")).alias("containment"), "from", places.alias("places"))
    sure = sure.where(F.col("containment") >= CONTAINED).select(
        "doc_id", "template", "containment",
        (F.col("from") + F.array_min("places") - 1).cast("int").alias("start"),
        (F.array_max("places") - F.array_min("places") + SHINGLE).cast("int").alias("n_tokens"),
    )
    best = F.max(F.struct("containment", (-F.col("start")).alias("start"), (-F.col("n_tokens")).alias("n_tokens"))).alias("x")
    out = sure.groupBy("doc_id", "template").agg(best)
    return out.select("doc_id", "template", "x.containment", (-F.col("x.start")).alias("start"), (-F.col("x.n_tokens")).alias("n_tokens"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of all documents; see the module."""
    return scanned(table(spark, sf_dir, "documents", "doc_id", "text"))
