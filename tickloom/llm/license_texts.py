"""Licence notices that files carry, with the phrase of each that must stand in it word for word.

Fixed values: the wording of the licences themselves.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    """key: words that follow one another in text."""

    label: str
    text: str
    key: str


TEMPLATES = (
    Template(
        "agpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "GNU Affero General Public License as published by",
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0"),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses",
    ),
    Template(
        "artistic-2.0",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This license establishes the terms under which a given free software Package may be copied",
        "under which a given free software Package may be copied",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistribution and use in source and binary forms",
    ),
    Template(
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "used to endorse or promote products derived from this software",
    ),
    Template(
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "any person or organization obtaining a copy of the software and accompanying documentation",
    ),
    Template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", "Boost Software License, Version 1.0"),
    Template("cc-by-4.0", "licensed under CC BY 4.0", "licensed under CC BY 4.0"),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International"),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", "licensed under CC BY-NC 4.0"),
    Template("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 International"),
    Template("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", "licensed under CC BY-SA 4.0"),
    Template("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 International"),
    Template(
        "cc0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "waived all copyright and related or neighboring rights",
    ),
    Template(
        "epl-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
        "Eclipse Public License 2.0",
    ),
    Template(
        "gpl-2.0",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "GNU General Public License as published by the Free Software Foundation; either version 2",
    ),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", "GNU General Public License, version 2"),
    Template(
        "gpl-3.0",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "GNU General Public License as published by the Free Software Foundation, either version 3",
    ),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", "GNU General Public License, version 3"),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "distribute this software for any purpose with or without fee is hereby granted",
    ),
    Template(
        "lgpl",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "GNU Lesser General Public License",
    ),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    Template("mit", "Released under the MIT License", "under the MIT License"),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    Template(
        "wtfpl",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
        "changing it is allowed as long as the name is changed",
    ),
    Template(
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "to alter it and redistribute it freely, subject to the following restrictions",
    ),
)
