"""keepwise — subscriber-retention analytics as Spark jobs.

Every operator takes and returns DataFrames; the heavy work (scans, joins,
aggregates, windows, ML fits) runs on executors. Only bounded, model- or
histogram-sized results ever reach the driver.
"""

__version__ = "0.1.0"
