"""Wording of public licences, the templates that the classifier of licence texts is trained on.

Short licences stand whole. Of long ones there are the passages that are their own: preamble, definitions and grants.
"""

_AS_IS_MIT = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_AS_IS_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_AS_IS_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_GNU_SHARED = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."

#: Per licence its passages; the grant comes first, and a variant always holds it.
TEXTS = {
    "MIT": (_MIT_GRANT + ", subject to the following conditions:", _MIT_NOTICE, _AS_IS_MIT),
    "ISC": (_ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.", _AS_IS_ISC),
    "BSD-2-Clause": (_BSD_GRANT, _BSD_1, _BSD_2, _AS_IS_BSD),
    "BSD-3-Clause": (_BSD_GRANT, _BSD_1, _BSD_2, _BSD_3, _AS_IS_BSD),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY.',
    ),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "3. This notice may not be removed or altered from any source distribution.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    "Apache-2.0": (
        '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.',
        '"Legal Entity" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity.',
        '"Contribution" shall mean any work of authorship, including the original version of the Work and any modifications or additions to that Work or Derivative Works thereof, that is intentionally submitted to Licensor for inclusion in the Work by the copyright owner.',
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "You must cause any modified files to carry prominent notices stating that You changed the files; and You must retain, in the Source form of any Derivative Works that You distribute, all copyright, patent, trademark, and attribution notices from the Source form of the Work.",
    ),
    "GPL-2.0": (
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it.",
        'This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License. The "Program", below, refers to any such program or work, and a "work based on the Program" means either the Program or any derivative work under copyright law.',
        "You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty.",
        _GNU_SHARED,
    ),
    "GPL-3.0": (
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
        '"The Program" refers to any copyrightable work licensed under this License. Each licensee is addressed as "you". To "modify" a work means to copy from or adapt all or part of the work in a fashion requiring copyright permission, other than the making of an exact copy.',
        "To protect your rights, we need to prevent others from denying you these rights or asking you to surrender the rights. Some devices are designed to deny users access to install or run modified versions of the software inside them, although the manufacturer can do so.",
        _GNU_SHARED,
    ),
    "AGPL-3.0": (
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
        "A secondary benefit of defending all users' freedom is that improvements made in alternate versions of the program, if they receive widespread use, become available for other developers to incorporate. It requires the operator of a network server to provide the source code of the modified version running there to the users of that server.",
        "Remote Network Interaction. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version.",
        _GNU_SHARED,
    ),
    "LGPL-2.1": (
        "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it. You can use it too, but we suggest you first think carefully about whether this license or the ordinary General Public License is the better strategy to use in any particular case.",
        'A "library" means a collection of software functions and/or data prepared so as to be conveniently linked with application programs (which use some of those functions and data) to form executables. The "Library", below, refers to any such software library or work which has been distributed under these terms.',
        "We call this license the \"Lesser\" General Public License because it does Less to protect the user's freedom than the ordinary General Public License. It also provides other free software developers Less of an advantage over competing non-free programs.",
        _GNU_SHARED,
    ),
    "MPL-2.0": (
        '"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor\'s Contribution.',
        '"Covered Software" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof.',
        'All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License. You must inform recipients that the Source Code Form of the Covered Software is governed by the terms of this License, and how they can obtain a copy of this License.',
    ),
}

#: Licences that are none of the catalogue's: the first are trained on as the class "other", the rest only set the rejection.
RELATED = {
    "MIT-0": (_MIT_GRANT + ".", _AS_IS_MIT),
    "X11": (_MIT_GRANT + ", subject to the following conditions:", _MIT_NOTICE, "Except as contained in this notice, the name of the copyright holders shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization."),
    "JSON": (_MIT_GRANT + ", subject to the following conditions:", _MIT_NOTICE, "The Software shall be used for Good, not Evil."),
    "0BSD": (_ISC_GRANT + ".", _AS_IS_ISC),
    "BSD-4-Clause": (_BSD_GRANT, _BSD_1, _BSD_2, "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.", _BSD_3, _AS_IS_BSD),
    "Apache-1.1": (_BSD_GRANT, _BSD_1, _BSD_2, "3. The end-user documentation included with the redistribution, if any, must include the following acknowledgment. Alternately, this acknowledgment may appear in the software itself, if and wherever such third-party acknowledgments normally appear.", "4. The names must not be used to endorse or promote products derived from this software without prior written permission."),
    "BSD-1-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following condition is met: Redistributions of source code must retain the above copyright notice, this condition and the following disclaimer.",),
    "BSD-Clear": (_BSD_GRANT, _BSD_1, _BSD_2, _BSD_3, "NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'S PATENT RIGHTS ARE GRANTED BY THIS LICENSE."),
    "WTFPL": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. You just do what you want to.",),
    "CC0": ("The person who associated a work with this deed has dedicated the work to the public domain by waiving all of their rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",),
    "Owned": ("All rights reserved. This file is confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited. No part of it may be reproduced without written permission of the owner.",),
}
UNKNOWN = {
    "EPL": ("THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT. Each Contributor hereby grants Recipient a non-exclusive, worldwide, royalty-free copyright license to reproduce, prepare derivative works of, publicly display, publicly perform, distribute and sublicense the Contribution.",),
    "Artistic": ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed. The intent is that the Copyright Holder maintains some artistic control over the development of that Package while still keeping the Package available as open source and free software.",),
    "OFL": ("Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy, merge, embed, modify, redistribute, and sell modified and unmodified copies of the Font Software, subject to the following conditions: Neither the Font Software nor any of its individual components, in Original or Modified Versions, may be sold by itself.",),
    "PostgreSQL": ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",),
    "HPND": ("Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies, and that both that the copyright notice and this permission notice appear in supporting documentation, and that the name of the holder not be used in advertising or publicity pertaining to distribution of the software without specific, written prior permission.",),
    "Beerware": ("As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return.",),
    "Python": ("This LICENSE AGREEMENT is between the Foundation and the Individual or Organization accessing and otherwise using this software in source or binary form and its associated documentation. Licensor hereby grants Licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test, perform and display publicly, prepare derivative works, distribute, and otherwise use the software alone or in any derivative version.",),
    "CC-BY": ("By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this Public License. The Licensor hereby grants You a worldwide, royalty-free, non-sublicensable, non-exclusive, irrevocable license to exercise the Licensed Rights in the Licensed Material to reproduce and Share the Licensed Material, in whole or in part.",),
}

#: Prose that grants nothing, for the class "none".
PROSE = (
    _AS_IS_MIT, _AS_IS_BSD, _AS_IS_ISC, _GNU_SHARED,
    "This program is free software; you can redistribute it and/or modify it under the terms of the license as published by the Free Software Foundation.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. You should have received a copy of the license along with this program.",
    "You may not use this file except in compliance with the License. You may obtain a copy of the License at the address given. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "See the LICENSE file in the root of this repository for the terms that apply to this file and to the rest of the tree.",
    "This file is part of the library. Copyright by the contributors, all changes after that year follow the same terms.",
    "This module implements the parser of configuration files and the functions that the server calls to reload them at run time.",
    "Returns the number of elements in the container, or a negative value if an error occurred while the buffer was being read.",
    "The copy constructor must not be used here because the object owns its memory; use the factory function or move it instead.",
    "Permission checks are done by the caller before this function runs, so that any person with access to the file can use it.",
    "Helper functions for tests. They may be used in source and binary form tests of the build, with or without the debug flags.",
    "TODO: choose the terms before the first release and ask the maintainers for their written agreement.",
    "Questions go to the maintainers through the tracker of the project; no promise is made that the software does anything useful.",
    "Modified by the team to fix a crash when the input is empty. The original version of this code was written for another system.",
)
