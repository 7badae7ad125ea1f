"""Operator 8: find texts that are a known licence, by the digest of their canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.common import table

#: Spellings that count as one, variant first.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
    "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
    "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
    "OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted{}.\n"
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
    "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
    "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

#: Public licence texts and notices by their SPDX names.
CATALOGUE = [
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:\nThe above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.\n" + _AS_IS,
    ),
    ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", _ISC.format("")),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    (
        "BSD-3-Clause",
        _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL,
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License '
        "for the specific language governing permissions and limitations under the License.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
]

#: SHA-256 of the canonical form of long licences, whole as their stewards publish them.
DIGESTS = {
    "Apache-2.0": "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2-only": "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71",
    "GFDL-1.3-only": "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6",
    "GPL-1.0-only": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0-only": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0-only": "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
    "LGPL-2.0-only": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1-only": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0-only": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}

#: A line that only names the holder of a copyright.
COPYRIGHT_LINE = (
    r"(?m)^[ \t*#/;-]*(?:(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©|[0-9<\[])[^\n]*|©[^\n]*|all rights reserved[.]?[ \t\r]*)$"
)
NOT_WORD = r"[^\p{L}\p{N}]+"
_VARIANT = r"(?:^| )(?:" + "|".join(SPELLINGS) + r")(?: |$)"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words alone with one space between, variant spellings made one."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    words = F.trim(F.regexp_replace(plain, NOT_WORD, " "))

    def spelt(word: Column) -> Column:
        out = None
        for variant, usual in SPELLINGS.items():
            out = F.when(word == variant, usual) if out is None else out.when(word == variant, usual)
        return out.otherwise(word)

    return F.when(words.rlike(_VARIANT), F.array_join(F.transform(F.split(words, " "), spelt), " ")).otherwise(words)


def scan_licences(
    docs: DataFrame, catalogue: DataFrame, digests: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Say of every whole text which known licence it is.

    Texts and the ``catalogue`` (licence, text) pass through ``canonical`` and are joined by the SHA-256
    of the result; ``digests`` (licence, digest) are known beside the catalogue's. So two texts match when they differ in case, punctuation, spacing, copyright lines or
    equivalent spellings alone. If two licences share a canonical text, the first name in order wins.
    Nothing is hinted: Spark broadcasts the catalogue where its size allows and splits hot digests else.

    Returns one row per input row: id, ``digest`` (null if no words are left), ``licence`` (null if
    unknown). Null and empty texts match nothing, nor do empty catalogue texts. Repeated rows stay
    repeated, an empty table gives an empty result, and other columns are ignored.
    """
    texts = catalogue.select("licence", canonical(F.col("text")).alias("canon")).where("canon <> ''")
    listed = texts.select("licence", F.sha2(F.col("canon").cast("binary"), 256).alias("known_digest"))
    if digests is not None:
        listed = listed.union(digests.select("licence", F.col("digest").alias("known_digest")).where("digest is not null"))
    known = listed.groupBy("known_digest").agg(F.min("licence").alias("licence"))
    canon = docs.select(F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("canon"))
    digests = canon.select(
        "id", F.when(F.col("canon") != "", F.sha2(F.col("canon").cast("binary"), 256)).alias("digest")
    )
    return digests.join(known, F.col("digest") == F.col("known_digest"), "left").select(
        F.col("id").alias(id_col), "digest", "licence"
    )


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(CATALOGUE, "licence string, text string")
    return scan_licences(table(spark, sf_dir, "documents"), known, known_digests(spark))


def known_digests(spark: SparkSession) -> DataFrame:
    """(licence, digest) of the long licences."""
    return spark.createDataFrame(list(DIGESTS.items()), "licence string, digest string")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    words = (
        f"trim(regexp_replace(regexp_replace(lower(coalesce({text}, '')), {_quoted(COPYRIGHT_LINE)}, '', 'g'), "
        f"{_quoted(NOT_WORD)}, ' ', 'g'))"
    )
    cases = " ".join(f"when {_quoted(a)} then {_quoted(b)}" for a, b in SPELLINGS.items())
    return f"array_to_string(list_transform(string_split({words}, ' '), lambda w: case w {cases} else w end), ' ')"


OP8_SQL = f"""
with known as (
  select sha256(canon) as digest, min(licence) as licence
  from (select licence, {_canonical_sql('body')} as canon
        from (values {', '.join(f'({_quoted(n)}, {_quoted(t)})' for n, t in CATALOGUE)}) as t(licence, body))
  where canon <> '' group by 1
  union all select unnest({[d for d in DIGESTS.values()]}), unnest({list(DIGESTS)})
), docs as (
  select doc_id, case when canon <> '' then sha256(canon) end as digest
  from (select doc_id, {_canonical_sql('text')} as canon from documents)
)
select doc_id, docs.digest, licence from docs left join known on docs.digest = known.digest
"""
