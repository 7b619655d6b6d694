"""finescale: statistical downscaling of gridded air temperature as Spark jobs.

Every public function takes and returns Spark DataFrames (or Column expressions) and is
lazy unless its docstring says otherwise.
"""

__version__ = "0.1.0"
