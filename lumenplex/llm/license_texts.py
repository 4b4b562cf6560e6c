"""Licence texts as word sequences, with the phrases that each of them must hold."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Phrase:
    """A licence's name: `key` is found wherever its words stand consecutively; `line` is the sentence it is scored against."""

    label: str
    key: str
    line: str
    base: bool = False


@dataclass(frozen=True)
class Template:
    """A licence's own words. Every key must stand in a copy of it, word for word."""

    label: str
    keys: tuple[str, ...]
    text: str


# Names of licences, and their public texts or the notices that they ask for, in lower case.

#: Base phrases, and the method's own labels.
PHRASES = (
    Phrase("mit", "mit license", "released under the mit license", base=True),
    Phrase("apache", "apache license", "licensed under the apache license version 2 0", base=True),
    Phrase("gpl", "general public license", "this work is licensed under the gnu general public license version 3", base=True),
    Phrase("lgpl", "lesser general public license", "licensed under the gnu lesser general public license"),
    Phrase("agpl", "affero general public license", "licensed under the gnu affero general public license version 3"),
    Phrase("mpl", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    Phrase("epl", "eclipse public license", "available under the terms of the eclipse public license 2 0"),
    Phrase("bsd", "bsd license", "released under the bsd license"),
    Phrase("isc", "isc license", "licensed under the isc license"),
    Phrase("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    Phrase("cc-by", "cc by", "licensed under cc by 4 0"),
    Phrase("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    Phrase("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    Phrase("cc0", "cc0", "dedicated to the public domain under cc0 1 0"),
    Phrase("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    Phrase("proprietary", "all rights reserved", "all rights reserved"),
)

_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution"
)
_BSD_NAMES = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_TAIL = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
    "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors "
    "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods "
    "or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability "
    "or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_GNU = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation "
    "either version {version} of the license or at your option any later version this program is distributed in the hope that it will be useful "
    "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {name} for more details "
    "you should have received a copy of the gnu {name} along with this program if not see"
)

TEMPLATES = (
    Template(
        "mit",
        ("permission is hereby granted free of charge", "the above copyright notice and this permission notice shall be included"),
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
        "sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _WARRANTY + " "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    Template("bsd-2-clause", ("redistribution and use in source and binary forms",), f"{_BSD_HEAD} {_BSD_TAIL}"),
    Template("bsd-3-clause", ("redistribution and use in source and binary forms", "nor the names of its contributors"), f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}"),
    Template(
        "isc",
        ("permission to use copy modify and or distribute this software for any purpose",),
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
        "and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software "
        "including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages "
        "or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
        "arising out of or in connection with the use or performance of this software",
    ),
    Template(
        "zlib",
        ("the origin of this software must not be misrepresented",),
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
        "subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software "
        "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "this notice may not be removed or altered from any source distribution",
    ),
    Template(
        "bsl",
        ("boost software license",),
        "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software "
        "and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software "
        "and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
    ),
    Template(
        "unlicense",
        ("free and unencumbered software",),
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    Template(
        "apache",
        ("licensed under the apache license", "you may not use this file except in compliance with the license"),
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
        "as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    Template(
        "mpl",
        ("mozilla public license",),
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    ),
    Template("gpl", ("it under the terms of the gnu general public license",), _GNU.format(name="general public license", version="3")),
    Template("lgpl", ("it under the terms of the gnu lesser general public license",), _GNU.format(name="lesser general public license", version="3")),
    Template("agpl", ("it under the terms of the gnu affero general public license",), _GNU.format(name="affero general public license", version="3")),
)
