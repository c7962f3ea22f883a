"""Whole license wordings: accepted as published, rejected with one mandatory word changed."""

import re

import pyarrow as pa
import pytest

from aerotrace.llm import textvec as tv
from aerotrace.llm.license_scan import PHRASES, TEMPLATES, Matcher

MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
BSD3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

WHOLE = {"mit-text": MIT, "isc-text": ISC, "bsd-3-clause-text": BSD3, "apache-2.0-header": APACHE}
#: A mandatory word of each, near its start, middle and end.
MANDATORY = {"mit-text": ["obtaining", "sublicense", "dealings"], "isc-text": ["purpose", "disclaims", "tortious"], "bsd-3-clause-text": ["binary", "endorse", "theory"], "apache-2.0-header": ["compliance", "agreed", "governing"]}


@pytest.fixture(scope="module")
def labels():
    matcher = Matcher(PHRASES, TEMPLATES)
    return lambda t: (lambda x: (set(filter(None, x[5].split(","))), x[6]))(matcher.chunk(tv.Chunk(*tv.flat(pa.array([f"some words before. {t}\nand after"])), 0))[0])


@pytest.mark.parametrize("label", WHOLE)
def test_whole_wording(labels, label):
    found, score = labels(WHOLE[label])
    assert label in found and score == 1
    for word in MANDATORY[label]:
        changed, n = re.subn(rf"\b{word}\b", "otherwise", WHOLE[label], count=1, flags=re.I)
        found, score = labels(changed)
        assert n == 1 and label not in found and score < 1


def test_replaceable_and_optional_regions(labels):
    assert "isc-text" in labels(ISC.replace("THE AUTHOR", "SOME FOUNDATION AND ITS FRIENDS").replace("and/or", "and"))[0]
    assert "bsd-3-clause-text" in labels(re.sub(r"(?m)^[123]\. ", "* ", BSD3))[0]
    assert "bsd-2-clause-text" in labels(re.sub(r"3\. Neither.*permission\.", "", BSD3, flags=re.S))[0]
    assert "mit-text" not in labels(MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "ANY OF " * 6))[0]


def test_score_grows_with_the_share_of_words(labels):
    assert labels("nothing")[1] == 0
    few, many = (labels("cc by " + "word " * n)[1] for n in (50, 5))
    notice = labels("released under the MIT license")[1]
    assert 0.25 < few < many < 0.5 < notice < 1
    assert labels("GNU General Public License v2.0")[0] == {"gpl", "gpl-2.0"}
