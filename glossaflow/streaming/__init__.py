"""The same plans over streams; every column operator is stateless."""
