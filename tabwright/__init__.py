"""tabwright: text-to-table data jobs expressed as Spark DataFrame plans.

Every public operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function; nothing is collected to the driver.
"""

__version__ = "0.1.0"
