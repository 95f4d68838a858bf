import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clauselake.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"

AGREEMENT = """
RULES OF THE BOAT JETTY

Words used here:

A berth is one numbered place at the jetty; the keeper is whoever
holds the key to it for a summer.

I. SUMMER SEASON

The jetty opens once the ice has gone and closes again as of October 31, 2024.

II. MONEY MATTERS

2.1 Reminders. One goes out after two weeks, or call 555-010-4477 before that.

2.2.1 Key Deposit. It comes back in the autumn.

Each keeper owes the fees described in Schedule 7, and the harbour office
keeps the right to modify rates from one summer to the next without asking anyone.

2.3 Winter. Boats that stay on land pay nothing.

III. STORMS AND ICE

When the flag is red all boats are doubled up on the lee side,
no matter who holds the key to the place they are tied to.

IV. VISITING BOATS
"""


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", memory="6g", shuffle=4)


@pytest.fixture(scope="session")
def agreement(spark):
    return spark.createDataFrame([(1, "document.txt", AGREEMENT)], "doc_id bigint, file_name string, text string")
