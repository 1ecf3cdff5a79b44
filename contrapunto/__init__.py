"""Set-at-a-time procurement record analytics on Spark.

Every public function takes DataFrames and returns DataFrames; nothing here
reads the clock, opens a network connection or keeps state on the driver.
"""
