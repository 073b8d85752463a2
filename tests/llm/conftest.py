import time

import pytest


@pytest.fixture(scope="module", autouse=True)
def no_workers_of_other_tests(request, spark):
    """Tests of what workers hold look at those that wait; Spark ends the ones that others left after an idle minute."""
    if request.module.__name__.endswith("test_memory"):
        time.sleep(75)
