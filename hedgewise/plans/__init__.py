"""Plan-shaping helpers shared by the operators."""

from hedgewise.plans.batches import bounded_batches
from hedgewise.plans.joins import fits_in_broadcast, keyed_join, sized_join
from hedgewise.plans.numbering import numbered
from hedgewise.plans.scratch import scratch_path, written
from hedgewise.plans.tables import literal_table

__all__ = ["bounded_batches", "fits_in_broadcast", "keyed_join", "literal_table", "numbered", "scratch_path", "sized_join", "written"]
