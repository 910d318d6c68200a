"""Texts of public licences, as their authors publish them, and the usual variants of them.

``KNOWN`` holds eight short texts, ``EVERY`` these, the texts in ``license_texts`` and variants: titles, bullets for numbers,
names in the third BSD clause, addresses of the Free Software Foundation, and texts that are not broken into lines or lack the
instructions after their terms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib import resources

# Licence texts.
MIT = """\
MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""

ISC = """\
ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""

BSD_0 = """\
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""

BSD_2_CLAUSE = """\
Copyright (c) <year> <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

BSD_3_CLAUSE = """\
Copyright (c) <year> <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

ZLIB = """\
Copyright (c) <year> <owner>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
"""

UNLICENSE = """\
This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>
"""

BSL_1_0 = """\
Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""

#: Licence names (SPDX) and texts.
KNOWN = (
    ("0BSD", BSD_0),
    ("BSD-2-Clause", BSD_2_CLAUSE),
    ("BSD-3-Clause", BSD_3_CLAUSE),
    ("BSL-1.0", BSL_1_0),
    ("ISC", ISC),
    ("MIT", MIT),
    ("Unlicense", UNLICENSE),
    ("Zlib", ZLIB),
)

# Usual titles of texts that are also published under another one, or none.
TITLES = {
    "0BSD": ("", "0BSD", "Zero-Clause BSD", "BSD Zero Clause License", "BSD Zero Clause License (0BSD)", "Free Public License 1.0.0"),
    "BSD-2-Clause": (
        "", "BSD-2-Clause", "BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "2-Clause BSD License", 'BSD 2-Clause "Simplified" License',
        "Simplified BSD License", "The Simplified BSD License", "FreeBSD License", "BSD License", "The BSD License", "BSD 2-Clause License (FreeBSD/Simplified)",
    ),
    "BSD-3-Clause": (
        "", "BSD-3-Clause", "BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License',
        "New BSD License", "The New BSD License", "Modified BSD License", "Revised BSD License", "BSD License", "The BSD License", "BSD 3-Clause License (Revised)",
    ),
    "BSL-1.0": ("", "Boost Software License 1.0", "Boost Software License - Version 1.0", "Boost Software License, Version 1.0"),
    "ISC": ("", "ISC", "The ISC License", "ISC License (ISC)", "ISC License (ISCL)", "The ISC License (ISC)"),
    "MIT": ("", "MIT", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "License: MIT", "MIT License (Expat)", "Expat License", "License", "The MIT License:"),
    "Unlicense": ("", "Unlicense", "The Unlicense", "The Unlicense (Unlicense)"),
    "Zlib": ("", "Zlib", "zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License", "zlib License (Zlib)"),
}
# The first lines of the texts above that are titles.
OWN_TITLES = ("MIT License", "ISC License", "Boost Software License - Version 1.0 - August 17th, 2003")
BULLETS = ("123", ("", "", ""), "abc", ("i", "ii", "iii"))
# Who "may not be used to endorse"; other names need a text of their own.
ENDORSERS = (
    "the copyright holder", "the copyright holders", "the author", "the authors", "the owner", "the project", "the organization", "the company",
    "the University", "the <organization>", "the <name>", "the copyright holder(s)",
)
# Names and files of the long texts; a text of a GNU licence does not say if later versions count.
LONG = (
    ("Apache-2.0", "Apache-2.0"), ("Artistic-1.0-Perl", "Artistic"), ("BSD-3-Clause", "BSD"), ("CC0-1.0", "CC0-1.0"), ("GFDL-1.2", "GFDL-1.2"),
    ("GFDL-1.3", "GFDL-1.3"), ("GPL-1.0", "GPL-1"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.0", "LGPL-2"), ("LGPL-2.1", "LGPL-2.1"),
    ("LGPL-3.0", "LGPL-3"), ("MPL-1.1", "MPL-1.1"), ("MPL-2.0", "MPL-2.0"),
)
_APPENDIX = re.compile(r"\n[ \t]*(?:APPENDIX: How to apply|(?:Appendix: )?How to Apply These Terms|ADDENDUM: How to use).*", re.DOTALL)
_END = re.compile(r"\n[ \t]*END OF TERMS AND CONDITIONS[ \t]*\n\s*\Z")
_ADDRESS = re.compile(r"51 Franklin St(?:reet)?, Fifth Floor,\s+Boston,? MA\s+02110-1301,?\s+USA")
# Former and other spellings of that address.
ADDRESSES = (
    "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA",
    "675 Mass Ave, Cambridge, MA 02139, USA", "675 Mass Ave, Cambridge, MA 02139",
)


def _short(name: str, text: str) -> Iterator[str]:
    """A short text under its titles, with its bullets and names."""
    head, _, rest = text.partition("\n")
    body = rest.lstrip("\n") if head in OWN_TITLES else text
    endorsers = ENDORSERS if name == "BSD-3-Clause" else ENDORSERS[:1]
    for endorser in endorsers:
        named = body.replace("Neither the name of the copyright holder", f"Neither the name of {endorser}")
        for marks in BULLETS if re.search(r"(?m)^1\. ", body) else BULLETS[:1]:
            listed = re.sub(r"(?m)^([123])\. ", lambda m, marks=marks: f"{marks[int(m[1]) - 1]}. ", named)
            for title in TITLES[name]:
                yield f"{title}\n\n{listed}"


def _long(text: str) -> Iterator[str]:
    """A long text with and without its instructions, as lines or paragraphs, with the addresses of its time."""
    terms = _APPENDIX.sub("\n", text)
    for part in dict.fromkeys((text, terms, _END.sub("\n", terms))):
        addressed = [_ADDRESS.sub(a, part) for a in ADDRESSES] if _ADDRESS.search(part) else []
        for one in (part, *addressed):
            yield one
            yield one.replace("use the GNU Lesser General", "use the GNU Library General")
        yield re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", part)


def _every() -> Iterator[tuple[str, str]]:
    yield from KNOWN
    for name, text in KNOWN:
        yield from ((name, t) for t in _short(name, text))
    for name, file in LONG:
        text = resources.files(__package__).joinpath("license_texts", f"{file}.txt").read_text("utf-8")
        yield from ((name, t) for t in _long(text))
        if file == "BSD":
            body = text.partition("\n\n")[2]
            for marks in BULLETS:
                listed = re.sub(r"(?m)^([123])\. ", lambda m, marks=marks: f"{marks[int(m[1]) - 1]}. ", body)
                yield from ((name, f"{title}\n\n{listed}") for title in TITLES[name])


#: Licence names and texts with all variants.
EVERY = tuple(dict.fromkeys(_every()))
