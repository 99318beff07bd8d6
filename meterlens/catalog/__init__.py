"""All registered queries by name."""

from meterlens.catalog.anomaly import ANOMALY
from meterlens.catalog.evaluation import EVALUATION
from meterlens.catalog.learning import LEARNING
from meterlens.catalog.planning import PLANNING
from meterlens.catalog.readings import READINGS
from meterlens.catalog.roundtrips import ROUNDTRIPS

QUERIES = {**READINGS, **EVALUATION, **ANOMALY, **PLANNING, **LEARNING, **ROUNDTRIPS}
