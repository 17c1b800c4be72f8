"""Table operators: every public function takes DataFrames and returns DataFrames."""
