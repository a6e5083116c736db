"""Jobs over keyed, ordered tables; every function takes and returns DataFrames."""
