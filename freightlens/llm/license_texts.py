"""Notices and whole texts of public licenses, as their publishers word them.

Texts that share paragraphs are put together from them.  Long licenses are known by their
opening passage and by the notice that their publisher asks for; whole files of them, or of
any other license, come from a folder (``licenses.templates_in``).
"""

MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
    " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
    " to permit persons to whom the Software is furnished to do so"
)
MIT_CONDITION = (
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included in"
    " all copies or substantial portions of the Software."
)
AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO'
    " THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
)
NO_CLAIM = (
    " BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING"
    " FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
MIT_WARRANTY = AS_IS + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS" + NO_CLAIM

BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: "
)
BSD_SOURCE = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
    " disclaimer. "
)
BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
    " disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_NOTICE = (
    "All advertising materials mentioning features or use of this software must display the following acknowledgement:"
    " This product includes software developed by the organization. "
)
BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission. "
)
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE"
    " USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_CONDITION = ", provided that the above copyright notice and this permission notice appear in all copies"
ISC_WARRANTY = (
    '. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING'
    " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
    " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,"
    " WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE"
    " USE OR PERFORMANCE OF THIS SOFTWARE."
)

VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
FSF = " Free Software Foundation, Inc. "


def _gnu_notice(kind: str, license: str, version: str, either: bool = True) -> str:
    """The notice that GNU licenses ask for in every file."""
    tail = f"either version {version} of the License, or (at your option) any later version." if either else f"version {version} of the License."
    stop = ";" if version in ("2", "2.1") else ":"
    return (
        f"This {kind} is free software{stop} you can redistribute it and/or modify it under the terms of the {license} as"
        f" published by the Free Software Foundation{';' if stop == ';' else ','} {tail}"
    )


#: Name to text; the earlier of two that match equally well is reported.
WHOLE = {
    "MIT-whole": MIT_GRANT + MIT_CONDITION + " " + MIT_WARRANTY,
    "MIT-0": MIT_GRANT + ". " + MIT_WARRANTY,
    "BSD-2-Clause": BSD_HEAD + BSD_SOURCE + BSD_BINARY + BSD_WARRANTY,
    "BSD-3-Clause": BSD_HEAD + BSD_SOURCE + BSD_BINARY + BSD_NAMES + BSD_WARRANTY,
    "BSD-4-Clause": BSD_HEAD + BSD_SOURCE + BSD_BINARY + BSD_NOTICE + BSD_NAMES + BSD_WARRANTY,
    "ISC": ISC_GRANT + ISC_CONDITION + ISC_WARRANTY,
    "0BSD": ISC_GRANT + ISC_WARRANTY,
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held"
        " liable for any damages arising from the use of this software. Permission is granted to anyone to use this software"
        " for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the"
        " following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you"
        " wrote the original software. If you use this software in a product, an acknowledgment in the product"
        " documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as"
        " such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered"
        " from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and"
        ' accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,'
        " execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties"
        " to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software"
        " and this entire statement, including the above license grant, this restriction and the following disclaimer, must"
        " be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless"
        " such copies or derivative works are solely in the form of machine-executable object code generated by a source"
        ' language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING'
        " BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND"
        " NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY"
        " DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE"
        " SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,"
        " use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any"
        " purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the"
        " author or authors of this software dedicate any and all copyright interest in the software to the public domain."
        " We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors."
        " We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to"
        " this software under copyright law. "
    )
    + AS_IS
    + "IN NO EVENT SHALL THE AUTHORS"
    + NO_CLAIM,
    "WTFPL": (
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it"
        " is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR"
        " COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."
    ),
    "GPL-2.0-header": _gnu_notice("program", "GNU General Public License", "2"),
    "GPL-2.0-only-header": _gnu_notice("program", "GNU General Public License", "2", either=False),
    "LGPL-3.0-header": _gnu_notice("program", "GNU Lesser General Public License", "3"),
    "AGPL-3.0-header": _gnu_notice("program", "GNU Affero General Public License", "3"),
    "GPL-2.0-opening": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991" + FSF + VERBATIM,
    "GPL-3.0-opening": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007" + FSF + VERBATIM,
    "LGPL-2.1-opening": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999" + FSF + VERBATIM,
    "LGPL-3.0-opening": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007" + FSF + VERBATIM,
    "AGPL-3.0-opening": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007" + FSF + VERBATIM,
    "Apache-2.0-opening": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE,"
        ' REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use,'
        " reproduction, and distribution as defined by Sections 1 through 9 of this document."
    ),
    "MPL-2.0-opening": (
        'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that'
        " creates, contributes to the creation of, or owns Covered Software."
    ),
    "CC0-1.0-opening": (
        "Statement of Purpose The laws of most jurisdictions throughout the world automatically confer exclusive Copyright"
        ' and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an "owner") of an'
        ' original work of authorship and/or a database (each, a "Work").'
    ),
}
