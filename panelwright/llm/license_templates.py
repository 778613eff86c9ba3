"""Wording of common licenses as templates: fixed values, which must equal the published texts.

``<<beginOptional>>`` ... ``<<endOptional>>`` may be left out; ``<<var;words=a..b>>`` stands for a to b words of any kind.
Case and punctuation don't matter. Longer texts are given by their operative part, from its first fixed word on.
"""

from __future__ import annotations

MIT_PERMISSION = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND <<beginOptional>>NON-INFRINGEMENT<<endOptional>>
<<beginOptional>>NONINFRINGEMENT<<endOptional>>. IN NO EVENT SHALL <<var;words=1..20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE
"""

ISC_PERMISSION = """
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words=1..12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;words=1..12>> BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE
"""

BSD_CONDITIONS = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution.
"""

BSD_NAMES = """
<<beginOptional>>3.<<endOptional>> Neither the name of <<var;words=1..20>> nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission.
"""

BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY <<var;words=1..20>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
<<var;words=1..20>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE
"""

APACHE_NOTICE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at <<var;words=4..12>> Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License
"""

GNU_NOTICE = """
free software: you can redistribute it and/or modify it under the terms of the GNU %s General Public License as published by the Free Software Foundation,
<<beginOptional>>either<<endOptional>> version %s of the License
<<beginOptional>>, or (at your option) any later version<<endOptional>>
"""

GNU_SHORT = """
under the <<beginOptional>>terms of the<<endOptional>> GNU %s General Public License <<beginOptional>>%s<<endOptional>>
<<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>version<<endOptional>>
<<beginOptional>>v<<endOptional>> %s <<beginOptional>>or<<endOptional>> <<beginOptional>>any<<endOptional>>
<<beginOptional>>later<<endOptional>>
"""

MPL_NOTICE = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at <<var;words=3..8>> MPL 2.0
"""

ZLIB_TERMS = """
This software is provided 'as-is', without any express or implied warranty. In no event will <<var;words=1..6>> be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
"""

UNLICENSE_TERMS = """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means
"""

BOOST_SHORT = "Distributed under the Boost Software License, Version 1.0"

CREATIVE_COMMONS = "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution %s <<var;words=0..2>> <<beginOptional>>International<<endOptional>> License"

CREATIVE_COMMONS_SHORT = "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY %s %s 0"

TEMPLATES: dict[str, list[str]] = {
    "mit": [MIT_PERMISSION, "<<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT <<beginOptional>>(Expat)<<endOptional>> License"],
    "isc": [ISC_PERMISSION, "under the ISC License"],
    "bsd-2-clause": [BSD_CONDITIONS + BSD_DISCLAIMER, "under the BSD 2-Clause License"],
    "bsd-3-clause": [BSD_CONDITIONS + BSD_NAMES + BSD_DISCLAIMER, "under the BSD 3-Clause License"],
    "apache-2": [APACHE_NOTICE, "licensed under the Apache License, <<beginOptional>>Version<<endOptional>> 2<<beginOptional>>.0<<endOptional>>", "SPDX-License-Identifier: Apache-2.0"],
    "gpl-2": [GNU_NOTICE % ("", "2"), GNU_SHORT % ("", "GPL", "2")],
    "gpl-3": [GNU_NOTICE % ("", "3"), GNU_SHORT % ("", "GPL", "3")],
    "lgpl-2.1": [GNU_NOTICE % ("Lesser", "2.1"), GNU_SHORT % ("Lesser", "LGPL", "2.1")],
    "lgpl-3": [GNU_NOTICE % ("Lesser", "3"), GNU_SHORT % ("Lesser", "LGPL", "3")],
    "agpl-3": [GNU_NOTICE % ("Affero", "3"), GNU_SHORT % ("Affero", "AGPL", "3")],
    "mpl-2": [MPL_NOTICE, "under the Mozilla Public License, <<beginOptional>>Version<<endOptional>> <<beginOptional>>v.<<endOptional>> 2.0"],
    "zlib": [ZLIB_TERMS, "under the zlib License"],
    "unlicense": [UNLICENSE_TERMS],
    "bsl-1": [BOOST_SHORT],
    "cc0": ["<<beginOptional>>CC0<<endOptional>> 1.0 Universal Public Domain Dedication", "licensed under CC0 1.0"],
    "cc-by": [CREATIVE_COMMONS % "", *(CREATIVE_COMMONS_SHORT % ("", v) for v in "234")],
    "cc-by-sa": [CREATIVE_COMMONS % "ShareAlike", CREATIVE_COMMONS % "Share Alike", *(CREATIVE_COMMONS_SHORT % ("SA", v) for v in "234")],
    "cc-by-nc": [CREATIVE_COMMONS % "NonCommercial", CREATIVE_COMMONS % "Non-Commercial", *(CREATIVE_COMMONS_SHORT % ("NC", v) for v in "234")],
    "cc-by-nc-sa": [CREATIVE_COMMONS % "NonCommercial-ShareAlike", *(CREATIVE_COMMONS_SHORT % ("NC-SA", v) for v in "234")],
    "cc-by-nd": [CREATIVE_COMMONS % "NoDerivatives", CREATIVE_COMMONS % "NoDerivs", *(CREATIVE_COMMONS_SHORT % ("ND", v) for v in "234")],
}

#: Phrases whose every place counts.
PHRASES: dict[str, str] = {"mit": "under the MIT License", "apache-2": "Apache License, Version 2", "cc-by-nc": "CC BY-NC"}
