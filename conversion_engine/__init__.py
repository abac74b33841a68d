"""User-conversion analytics on Spark.

Install logs, app-event logs, bookings and dimension tables go in; one wide
feature row per installed device comes out, and a distributed classifier is
trained, evaluated and explained on it.
"""

__version__ = "0.1.0"
