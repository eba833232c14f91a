"""operators of the library; each public function takes and returns DataFrames."""
