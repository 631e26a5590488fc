"""skeinlab.sources"""
