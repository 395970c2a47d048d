"""Licence scans: canonical digests of whole texts, hash-joined to the digests of known licences.

Canonical form: lower case, without copyright lines and "all rights reserved", equivalent spellings made one, and each run of
anything but letters and digits made one space. Native functions only; the catalogue is a table of fixed size.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence texts and notices, as published.
_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
TEXTS = [
    ("MIT", _PERMISSION),
    ("MIT", "MIT License\n\n" + _PERMISSION),
    ("MIT", "The MIT License (MIT)\n\n" + _PERMISSION),
    ("BSD-2-Clause", f"{_REDISTRIBUTION}\n\n{_DISCLAIMER}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_REDISTRIBUTION}\n\n{_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_REDISTRIBUTION}\n\n{_NAMES}\n\n{_DISCLAIMER}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_REDISTRIBUTION}\n\n{_NAMES}\n\n{_DISCLAIMER}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_DISCLAIMER}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_DISCLAIMER}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_DISCLAIMER}"),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

# Digests of the canonical forms of licences too long to state here.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]

#: Equivalent spellings, applied in order to words with a space of their own on either side, so that equal neighbours both change.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("licencor", "licensor"), ("licencee", "licensee"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("sublicence", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
    ("organisation", "organization"), ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("judgement", "judgment"), ("fulfilment", "fulfillment"), ("merchantibility", "merchantability"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("https", "http"),
]
COPYRIGHT = r"(^|\n)[^\p{L}\p{N}(\n]*(?:copyright(?: by)? *(?:\(c\)|©|[0-9]{4}|[<\[{])|(?:\(c\)|©) *(?:copyright *)?[0-9<\[{])[^\n]*"
RESERVED = r"all rights reserved\.?"
OTHER = r"[^\p{L}\p{N}]+"


def apart(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def canonical(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, COPYRIGHT, "\n"), RESERVED, " ")
    t = F.concat(F.lit(" "), F.regexp_replace(t, OTHER, "  "), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(apart(a)), F.lit(apart(b)))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def canonical_sql(text: str) -> str:
    """The same in SQL, of a column."""
    t = f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT}', chr(10), 'g'), '{RESERVED}', ' ', 'g')"
    t = f"' ' || regexp_replace({t}, '{OTHER}', '  ', 'g') || ' '"
    for a, b in SPELLINGS:
        t = f"replace({t}, '{apart(a)}', '{apart(b)}')"
    return f"trim(replace({t}, '  ', ' '))"


def canonical_text(text: str) -> str:
    """The same in Python, for texts of ASCII."""
    t = text.lower()
    for pattern, by in ((COPYRIGHT, "\n"), (RESERVED, " "), (OTHER, "  ")):
        t = re.sub(pattern.replace(r"[^\p{L}\p{N}(\n]", r"[^a-z0-9(\n]").replace(r"[^\p{L}\p{N}]", "[^a-z0-9]"), by, t)
    t = f" {t} "
    for a, b in SPELLINGS:
        t = t.replace(apart(a), apart(b))
    return t.replace("  ", " ").strip(" ")


def catalogue(texts: list[tuple[str, str]] | None = None, digests: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """(digest, licence) in order, a row a digest."""
    known = {hashlib.sha256(canonical_text(t).encode()).hexdigest(): k for k, t in (TEXTS if texts is None else texts)}
    return sorted((known | {d: k for k, d in (DIGESTS if digests is None else digests)}).items())


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, canonical_sha256, license_id (null if the whole text is no known licence) and is_license of each row.

    A null text counts as empty, and the empty form is no licence; equal texts, repeated rows and null ids give
    a row each; other columns are ignored. known: (digest, licence) in place of catalogue(); an empty one knows none.
    """
    names = docs.sparkSession.createDataFrame(catalogue() if known is None else known, "canonical_sha256 string, license_id string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))
    return rows.join(F.broadcast(names), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def scan_sql() -> str:
    rows = ", ".join(f"('{d}', '{k}')" for d, k in catalogue())
    return f"""
WITH known(digest, license) AS (VALUES {rows}),
forms AS (SELECT doc_id, sha256({canonical_sql("text")}) AS digest FROM documents)
SELECT f.doc_id, f.digest AS canonical_sha256, k.license AS license_id, k.license IS NOT NULL AS is_license
FROM forms f LEFT JOIN known k USING (digest)"""
