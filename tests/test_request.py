import json

import pytest

from splitfold.errors import BadRequest
from splitfold.request import StepType, parse

STEPS = [{"sql": "SELECT * FROM t", "name": "m", "step_type": "HBee", "partition_filter": "k = '1'"}, {"sql": "SELECT * FROM m", "name": "r", "step_type": "HComb"}]
GOOD = {"steps": STEPS, "capacity": {"zones": 1}, "catalogs": [{"name": "t", "uri": "nyc_taxi_ursa", "type": "Static"}]}


def test_parses_json_text_and_dicts():
    for request in (GOOD, json.dumps(GOOD), json.dumps(GOOD).encode()):
        q = parse(request)
        assert q.map.step_type is StepType.MAP and q.reduce.name == "r" and q.map.partition_filter == "k = '1'"
    assert parse(GOOD | {"steps": [STEPS[0], STEPS[1] | {"partition_filter": "x"}]}).warnings


@pytest.mark.parametrize(
    "bad",
    ["no json", "[]", GOOD | {"steps": STEPS[:1]}, GOOD | {"steps": STEPS[::-1]}, GOOD | {"steps": [*STEPS, STEPS[1]]}, GOOD | {"capacity": {"zones": 2}}, GOOD | {"capacity": {}}, GOOD | {"catalogs": [{"name": "t", "uri": "u", "type": "Csv"}]}, GOOD | {"steps": [STEPS[0] | {"step_type": "x"}, STEPS[1]]}, GOOD | {"steps": [STEPS[0] | {"sql": None}, STEPS[1]]}, GOOD | {"catalogs": None}],
)
def test_bad_requests(bad):
    with pytest.raises(BadRequest):
        parse(bad)
