"""License scans: whole texts in a canonical form, joined by digest to known licences.

Canonical form: A-Z lowered; lines that state a copyright or reserve all rights dropped;
everything but a-z and 0-9 turned into single spaces; equivalent spellings unified. The
digest is SHA-256 of that form. The known table has a fixed number of rows (some tens), so
it is broadcast; documents are read once and never shuffled.

A text matches only as a whole. Null texts have no digest, texts whose canonical form is
empty match nothing. Very long texts are read whole. Repeated rows are answered each for
itself. Columns other than doc_id
and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Titles and bodies of licences as published, and short notices.
TITLES = {
    "MIT": ["", "MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["", "ISC License", "The ISC License"],
    "0BSD": ["", "BSD Zero Clause License", "Zero-Clause BSD", "Free Public License 1.0.0"],
    "BSD-2-Clause": ["", "BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["", "BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "Zlib": ["", "zlib License", "The zlib License", "The zlib/libpng License"],
    "Unlicense": ["", "The Unlicense", "Unlicense"],
    "BSL-1.0": ["", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "Apache-2.0-notice": [""],
    "GPL-3.0-notice": [""],
    "MIT-notice": [""],
    "CC-BY-NC-4.0-notice": [""],
}
_MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
BODIES = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _MIT_WARRANTY,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY,
    "BSD-2-Clause": f"{_BSD_START} {_BSD_WARRANTY}",
    "BSD-3-Clause": f"{_BSD_START} {_BSD_THIRD} {_BSD_WARRANTY}",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _MIT_WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS").replace(" OR OTHER LIABILITY", " OR OTHER LIABILITY") + " For more information, please refer to <https://unlicense.org/>",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}
# Equivalent spellings, as pairs of words (left becomes right), by the public matching guidelines.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"),
    ("sub license", "sublicense"), ("sub licence", "sublicense"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("https", "http"), ("per cent", "percent"),
]

_BIG, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# valid and alike in Java's, RE2's and Python's patterns
_CLAIM = r"(^|\n)[^a-z0-9\n]*(portions +)?(copyright +(\(c\)|©|[0-9])|\(c\) +(copyright|[0-9])|© *[0-9]|copyright +(holder|owner|statement|notice)s? *:|all +rights +reserved)[^\n]*"
# the words that make a line speak of copyright itself, not of a holder; marked, so that what remains is a name
_TERM = r"(Copyright) +((Holder|Owner|Licen[cs]e|Law|Notice|Statement)s?([^A-Za-z]|$))"
# a holder's name, which starts with a capital, after "Copyright" or "Copyright by"
_NAMED = r"(^|\n)[^A-Za-z0-9\n]*(Portions +)?Copyright +(by +)?[A-Z][^\n]*"
_GAP = "[^a-z0-9]+"

# Digests of the canonical forms of published texts too long to hold here.
DIGESTS = {
    "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60": "GFDL-1.2",
    "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826": "GFDL-1.3",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6": "MPL-1.1",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
}


def canonical(text: str) -> str:
    """The same form in Python, for the known texts and for tests."""
    x = re.sub(_NAMED, r"\1", re.sub(_TERM, r"\1 _\2", text)).translate(str.maketrans(_BIG, _LOW))
    x = " " + re.sub(_GAP, "  ", re.sub(_CLAIM, r"\1", x)) + " "
    for a, b in _spellings():
        x = x.replace(a, b)
    return re.sub(" +", " ", x).strip(" ")


def _spellings() -> list[tuple[str, str]]:
    """With two spaces between words, so that neighbours do not share one."""
    return [(f" {a} ".replace(" ", "  ")[1:-1], f" {b} ") for a, b in SPELLINGS]


def canonical_column(text: Column) -> Column:
    x = F.translate(F.regexp_replace(F.regexp_replace(text, _TERM, "$1 _$2"), _NAMED, "$1"), _BIG, _LOW)
    x = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(x, _CLAIM, "$1"), _GAP, "  "), F.lit(" "))
    for a, b in _spellings():
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, " +", " "))


def digest_column(text: Column) -> Column:
    return F.sha2(F.encode(canonical_column(text), "UTF-8"), 256)


def known() -> dict[str, str]:
    """Digest to licence."""
    return DIGESTS | {hashlib.sha256(canonical(f"{t}\n{BODIES[k]}").encode()).hexdigest(): k for k, titles in TITLES.items() for t in titles}


def scan(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license (null if unknown) for each row of docs (doc_id, text).

    `more` (license, text) adds known texts; of equal ones the least name counts. It is
    joined by hash, and broadcast only where Spark finds it small.
    """
    digest = docs.select("doc_id", digest_column(F.col("text")).alias("digest"))
    table = docs.sparkSession.createDataFrame(sorted(known().items()), "digest string, license string")
    if more is None:
        return digest.join(F.broadcast(table), "digest", "left").select("doc_id", "digest", "license")
    given = more.where("license is not null and text is not null").select(digest_column(F.col("text")).alias("digest"), "license")
    table = table.unionByName(given).groupBy("digest").agg(F.min("license").alias("license"))
    return digest.join(table, "digest", "left").select("doc_id", "digest", "license")


def oracle_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    x = f"' ' || regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(text, {q(_TERM)}, '\\1 _\\2', 'g'), {q(_NAMED)}, '\\1', 'g'), '{_BIG}', '{_LOW}'), {q(_CLAIM)}, '\\1', 'g'), {q(_GAP)}, '  ', 'g') || ' '"
    for a, b in _spellings():
        x = f"replace({x}, '{a}', '{b}')"
    rows = ", ".join(f"({q(d)}, {q(k)})" for d, k in sorted(known().items()))
    return f"""WITH known(digest, license) AS (VALUES {rows}),
forms AS (SELECT doc_id, sha256(trim(regexp_replace({x}, ' +', ' ', 'g'), ' ')) AS digest FROM documents)
SELECT doc_id, digest, license FROM forms LEFT JOIN known USING (digest)"""
