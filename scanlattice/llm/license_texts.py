"""Notices of public licences, sentence by sentence: (label, key phrase, sentence).

Fixed values: the published wording.  The key phrase must stand in full for a sentence to
count; a sentence is a template of its own, so that what a text leaves out between two
sentences moves neither out of place.
"""

SENTENCES = (
    (
        "mit",
        "associated documentation files the software to deal in the software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    (
        "mit",
        "this permission notice shall be included in all copies or substantial portions of the software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ),
    (
        "bsd",
        "redistributions in binary form must reproduce the above copyright notice",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    (
        "bsd-3-clause",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    (
        "isc",
        "distribute this software for any purpose with or without fee is hereby granted",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the license",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    (
        "gpl-3.0",
        "either version 3 of the license",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    (
        "gpl-2.0",
        "either version 2 of the license",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ),
    (
        "lgpl",
        "gnu lesser general public license",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    (
        "agpl",
        "gnu affero general public license",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    (
        "mpl-2.0",
        "source code form is subject to the terms of the mozilla public license",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    (
        "unlicense",
        "free and unencumbered software released into the public domain",
        "This is free and unencumbered software released into the public domain",
    ),
    (
        "zlib",
        "in no event will the authors be held liable for any damages arising from the use of this software",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
    ),
    (
        "bsl-1.0",
        "accompanying documentation covered by this license",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ),
    (
        "cc0-1.0",
        "waived all copyright and related or neighboring rights",
        "has waived all copyright and related or neighboring rights to this work",
    ),
)
