"""Verbatim licence headers and texts, wrapped, unwrapped and in comments."""

import re

import pytest

from gleaner.llm import licenses

APACHE = """   Copyright 2024 Somebody

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""
MIT = """Copyright (c) 2024 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
TEXTS = {"Apache-2.0": APACHE, "MIT": MIT, "GPL-3.0": GPL3, "GPL-2.0": GPL2, "BSD": BSD, "MPL-2.0": MPL}


def unwrapped(text):
    return "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))


@pytest.mark.parametrize("shape", [str, unwrapped, lambda t: re.sub("(?m)^", " * ", t), lambda t: re.sub("(?m)^", "# ", t),
                                   lambda t: t.replace("\n", "\r\n"), lambda t: "Some words before\n\n" + t + "\nafter"],
                         ids=["wrapped", "unwrapped", "stars", "hashes", "crlf", "inside"])
def test_verbatim_texts(spark, shape):
    df = spark.createDataFrame([(k, shape(t)) for k, t in TEXTS.items()], "doc_id string, text string")
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(df).collect()} == {k: k for k in TEXTS}


def test_talk_of_a_licence_is_none(spark):
    df = spark.createDataFrame([(1, "He said this program is free software and left."), (2, "The MIT License, in short, is short."),
                                (3, "a | Released under the MIT License.")],
                               "doc_id long, text string")
    assert [r["licenses"] for r in licenses.scan_licenses(df).collect()] == ["", "", ""]
