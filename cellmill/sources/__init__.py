"""cellmill.sources"""
